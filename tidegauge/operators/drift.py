"""Population stability of features and predictions, and the decision drawn from it.

Numeric features are compared over the deciles of the reference: the bin edges
are fitted once (eleven numbers per feature) and serve batch and stream alike.
Counting is one aggregate over a long frame for all features together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions.numeric import number
from tidegauge.operators.ranking import running_totals

BINS = 10
SHARE_FLOOR = 1e-6
WARNING, CRITICAL = 0.10, 0.20
MINIMUM_ROWS = 30
MISSING = "__missing__"

Edges = dict[str, list[float]]


def _probabilities(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def _ranked_quantiles(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Exact interpolated quantiles of all columns, from one ranking of (feature, value).

    Equal values are counted before they are ranked; no task holds a column.
    """
    names = [str(i) for i in range(len(columns))]
    values = df.select(*[number(c).alias(n) for n, c in zip(names, columns)])
    long = values.unpivot([], names, "feature", "v").where(F.col("v").isNotNull())
    counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, [F.col("feature"), F.col("v")], {"upto": F.col("n")})
    sizes = ranked.groupBy("feature").agg(
        F.min(F.col("upto") - F.col("n")).alias("start"), F.max("upto").alias("end")
    ).collect()  # one row per column
    if not sizes:
        return {c: [] for c in columns}
    wanted = {}
    for row in sizes:
        last = row["end"] - row["start"] - 1
        lows = [int(p * last) for p in _probabilities(bins)]
        wanted[row["feature"]] = row["start"], sorted({*lows, *[min(low + 1, last) for low in lows]})
    asked = F.create_map(
        *[x for f, (start, places) in wanted.items()
          for x in (F.lit(f), F.lit([start + k for k in places]).cast("array<bigint>"))]
    )
    hits = F.filter(
        F.try_element_at(asked, F.col("feature")),
        lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n")),
    )
    # at most two places per quantile and column come back
    found = ranked.select("feature", "v", hits.alias("hits")).where(F.size("hits") > 0).collect()
    at = {(row["feature"], place): row["v"] for row in found for place in row["hits"]}
    edges: dict[str, list[float]] = {c: [] for c in columns}
    for row in sizes:
        feature, start = row["feature"], row["start"]
        last = row["end"] - start - 1
        for p in _probabilities(bins):
            position = p * last
            low = int(position)
            high = min(low + 1, last)
            below, above = at[feature, start + low], at[feature, start + high]
            exact = position == low or below == above
            edges[columns[int(feature)]].append(below if exact else (high - position) * below + (position - low) * above)
    return edges


def fit_edges(
    reference: DataFrame,
    current: DataFrame | None,
    columns: list[str],
    bins: int = BINS,
    open_ended: bool = False,
) -> Edges:
    """Bin edges per numeric column: distinct reference quantiles, else equal widths.

    A column whose reference is one value falls back to equal widths over both
    sides; no spread at all gives no edges. ``open_ended`` moves the outer edges
    to infinity so that values outside the reference range are counted.
    """
    if not columns:
        return {}
    quantiles = _ranked_quantiles(reference, columns, bins)
    edges = {c: sorted(set(quantiles[c])) for c in columns}
    flat = [c for c in columns if len(edges[c]) == 1]
    if flat:
        sides = reference.select(*[number(c).alias(f"c{i}") for i, c in enumerate(flat)])
        if current is not None:
            sides = sides.unionByName(
                current.select(*[number(c).alias(f"c{i}") for i, c in enumerate(flat)])
            )
        bounds = sides.agg(
            *[F.min(f"c{i}").alias(f"lo{i}") for i in range(len(flat))],
            *[F.max(f"c{i}").alias(f"hi{i}") for i in range(len(flat))],
        ).first()
        for i, column in enumerate(flat):
            low, high = bounds[f"lo{i}"], bounds[f"hi{i}"]
            step = (high - low) / bins
            edges[column] = [] if low == high else [low + step * k for k in range(bins)] + [high]
    if open_ended:
        for column, cuts_of in edges.items():
            if len(cuts_of) > 1:
                edges[column] = [float("-inf"), *cuts_of[1:-1], float("inf")]
    return edges


def bin_number(column: str, edges: list[float]) -> Column:
    """Right-closed bin from 1 (first also closed left), 0 outside, null for no value."""
    value = number(column)
    if len(edges) < 2:
        return F.when(value.isNotNull(), F.lit(0))
    placed = F.when(value.isNull(), F.lit(None).cast("int")).when(value < edges[0], F.lit(0))
    for place, edge in enumerate(edges[1:], start=1):
        placed = placed.when(value <= edge, F.lit(place))
    return placed.otherwise(F.lit(0))


def count_bins(df: DataFrame, edges: Edges, keys: list[str] | None = None) -> DataFrame:
    """Rows per feature and bin: ``(*keys, feature, bin, n)``."""
    keys = keys or []
    names = list(edges)
    binned = df.select(*keys, *[bin_number(c, edges[c]).alias(c) for c in names])
    long = binned.unpivot(keys, names, "feature", "bin") if names else None
    return (
        long.where(F.col("bin").isNotNull())
        .withColumn("bin", F.col("bin").cast("string"))
        .groupBy(*keys, "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_categories(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows per feature and category, nulls as a category of their own."""
    keys = keys or []
    texts = df.select(
        *keys, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias(c) for c in columns]
    )
    return (
        texts.unpivot(keys, columns, "feature", "bin")
        .groupBy(*keys, "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_values(
    df: DataFrame, edges: Edges, categorical: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Bins and categories counted in one aggregate: ``(*keys, kind, feature, bin, n)``.

    ``kind`` is 'number' or 'text'. A stream in complete mode holds one aggregate only, so
    that both kinds share it; its state is one number per bin and per category.
    """
    keys = keys or []
    names = {f"n{i}": c for i, c in enumerate(edges)} | {f"t{i}": c for i, c in enumerate(categorical)}
    placed = df.select(
        *keys,
        *[bin_number(c, edges[c]).cast("string").alias(f"n{i}") for i, c in enumerate(edges)],
        *[
            F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias(f"t{i}")
            for i, c in enumerate(categorical)
        ],
    )
    spelled = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        placed.unpivot(keys, list(names), "_slot", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy(*keys, "_slot", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *keys, F.when(F.col("_slot").startswith("n"), F.lit("number")).otherwise(F.lit("text")).alias("kind"),
            F.element_at(spelled, F.col("_slot")).alias("feature"), "bin", "n",
        )
    )


def psi_from_values(reference: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stability index per feature from two counts of :func:`count_values`.

    Only numbers have values outside all bins; a category named '0' is one like any other.
    """
    number, text = F.col("kind") == "number", F.col("kind") == "text"
    return psi_from_counts(reference.where(number), current.where(number), keys).unionByName(
        psi_from_counts(reference.where(text), current.where(text), keys, outside=None)
    )


def psi_from_counts(
    reference: DataFrame,
    current: DataFrame,
    keys: list[str] | None = None,
    outside: str | None = "0",
) -> DataFrame:
    """Stability index per feature from two bin counts: ``(*keys, feature, psi)``.

    ``keys`` are extra columns of the current counts (one index per slice, all
    against the same reference). Bins named ``outside`` count as present values
    but take no part in the shares. A side without any value gives 0.
    """
    keys = keys or []
    group = [*keys, "feature"]
    left = reference.select("feature", "bin", F.col("n").alias("r"), F.lit(0).cast("long").alias("c"))
    if keys:
        slices = current.select(*group).distinct()
        left = slices.join(left, "feature")
    left = left.select(*group, "bin", "r", "c")
    right = current.select(*group, "bin", F.lit(0).cast("long").alias("r"), F.col("n").alias("c"))
    bins = left.unionByName(right).groupBy(*group, "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))

    inside = F.lit(True) if outside is None else F.col("bin") != outside
    counted = bins.withColumn("inside", inside)
    totals = counted.groupBy(*group).agg(
        *[F.sum(F.when(F.col("inside"), F.col(side)).otherwise(0)).alias(f"{side}_total") for side in "rc"]
    )

    def share(side: str) -> Column:
        return F.greatest(F.col(side) / F.greatest(F.col(f"{side}_total"), F.lit(1)), F.lit(SHARE_FLOOR))

    # a join rather than a window: a text feature may have very many categories
    shares = counted.join(totals, group).select(
        *group, share("r").alias("rs"), share("c").alias("cs"), "r", "c", "inside"
    )
    term = F.when(F.col("inside"), (F.col("cs") - F.col("rs")) * F.log(F.col("cs") / F.col("rs")))
    present = (F.sum("r") > 0) & (F.sum("c") > 0)
    return shares.groupBy(*group).agg(
        F.when(present, F.coalesce(F.sum(term), F.lit(0.0))).otherwise(0.0).alias("psi")
    )


def numeric_psi(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str],
    keys: list[str] | None = None,
    bins: int = BINS,
    open_ended: bool = False,
) -> DataFrame:
    """Stability index of numeric columns."""
    edges = fit_edges(reference, current, columns, bins, open_ended=open_ended)
    return psi_from_counts(count_bins(reference, edges), count_bins(current, edges, keys), keys)


def categorical_psi(
    reference: DataFrame, current: DataFrame, columns: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Stability index of text or discrete columns."""
    return psi_from_counts(
        count_categories(reference, columns), count_categories(current, columns, keys), keys, outside=None
    )


def _is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")


def feature_psi(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str] | None = None,
    categorical: list[str] | None = None,
    keys: list[str] | None = None,
    open_ended: bool = False,
) -> DataFrame:
    """Stability index of all columns, split by the type they have in the reference.

    ``categorical`` names number columns to compare value by value.
    """
    columns = columns or reference.columns
    kinds = dict(reference.dtypes)
    # numbers and booleans are binned; all other types are compared value by value
    texts = [c for c in columns if not _is_number(kinds[c]) or c in (categorical or [])]
    numbers = [c for c in columns if c not in texts]
    parts = []
    if numbers:
        parts.append(numeric_psi(reference, current, numbers, keys, open_ended=open_ended))
    if texts:
        parts.append(categorical_psi(reference, current, texts, keys))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def status_band(psi: Column, warning: float = WARNING, critical: float = CRITICAL) -> Column:
    """'critical', 'warning' or 'ok'."""
    return (
        F.when(psi >= critical, F.lit("critical")).when(psi >= warning, F.lit("warning")).otherwise(F.lit("ok"))
    )


def decide(
    psi: DataFrame,
    prediction: DataFrame | None = None,
    keys: list[str] | None = None,
    warning: float = WARNING,
    critical: float = CRITICAL,
) -> DataFrame:
    """One decision row per slice from the feature indices and the prediction index.

    ``prediction`` holds ``(*keys, prediction_psi)``.
    """
    keys = keys or []
    drifted = F.col("psi") >= warning
    summary = psi.groupBy(*keys).agg(
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_feature_psi"),
        F.coalesce(F.avg("psi"), F.lit(0.0)).alias("mean_feature_psi"),
        F.coalesce(
            F.try_divide(F.count_if(drifted), F.count(F.lit(1))).cast("double"), F.lit(0.0)
        ).alias("drifted_feature_share"),
        F.array_sort(F.collect_list(F.when(drifted, F.col("feature")))).alias("drifted_features"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias("feature_psi"),
    )
    if prediction is None:
        summary = summary.withColumn("prediction_psi", F.lit(None).cast("double"))
    elif keys:
        summary = summary.join(prediction.select(*keys, "prediction_psi"), keys, "left")
    else:
        # both sides are single rows
        one = prediction.select("prediction_psi", F.lit(1).alias("_one"))
        summary = summary.withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one")
    worst = F.greatest("max_feature_psi", F.coalesce("prediction_psi", F.lit(float("-inf"))))
    return summary.withColumn("status", status_band(worst, warning, critical))


def apply_minimum_sample(decision: DataFrame, rows: Column, minimum: int = MINIMUM_ROWS) -> DataFrame:
    """Withhold the decision below the least number of current rows; figures stay."""
    enough = rows >= F.lit(minimum)
    status = F.when(enough, F.col("status")).otherwise(F.lit("insufficient_data"))
    return decision.withColumns(
        {
            "status": status,
            "decision_eligible": enough,
            "minimum_current_sample_size_for_decision": F.lit(minimum),
            "retraining_recommended": status == F.lit("critical"),
        }
    )


def dataset_drift(psi: DataFrame, warning: float = WARNING) -> DataFrame:
    """Share of drifted columns, and whether it reaches one column's worth."""
    drifted = F.count_if(F.col("psi") >= warning)
    n = F.count(F.lit(1))
    return psi.agg(
        n.alias("n_features"),
        drifted.alias("n_drifted"),
        F.coalesce(F.try_divide(drifted, n).cast("double"), F.lit(0.0)).alias("drifted_share"),
        (drifted >= 1).alias("dataset_drift"),
    )


def metrics_payload(
    decision: DataFrame, reference_rows: Column, current_rows: Column, created_at: str
) -> DataFrame:
    """The full metrics row of a monitoring run."""
    return decision.select(
        F.lit(created_at).alias("created_at"),
        "status",
        "retraining_recommended",
        "max_feature_psi",
        "mean_feature_psi",
        "drifted_feature_share",
        "prediction_psi",
        "drifted_features",
        "feature_psi",
        reference_rows.cast("long").alias("reference_row_count"),
        current_rows.cast("long").alias("current_row_count"),
        "minimum_current_sample_size_for_decision",
        "decision_eligible",
    )


def edges_table(spark: SparkSession, edges: Edges, version: str) -> DataFrame:
    """Fitted edges as a table, one row per feature, stamped with the reference version."""
    rows = [(version, feature, [float(v) for v in values]) for feature, values in edges.items()]
    return spark.createDataFrame(rows, "reference_version string, feature string, edges array<double>")


def edges_from_table(table: DataFrame, version: str) -> Edges:
    """Read fitted edges back; one row per feature."""
    rows = table.where(F.col("reference_version") == version).collect()
    return {r["feature"]: list(r["edges"]) for r in rows}
