"""Model quality: threshold metrics, exact AUC, top-fraction metrics, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.numeric import ratio
from tidegauge.operators.ranking import running_totals, segmented_scan, top_count, with_key_sums

RECALL_FRACTION, PRECISION_FRACTION = 0.25, 0.20


def confusion(predicted: Column, label: Column, weightless: str = "") -> dict[str, Column]:
    """The four counts as aggregates."""
    return {
        f"tp{weightless}": F.count_if(predicted & (label == 1)),
        f"fp{weightless}": F.count_if(predicted & (label == 0)),
        f"fn{weightless}": F.count_if(~predicted & (label == 1)),
        f"tn{weightless}": F.count_if(~predicted & (label == 0)),
    }


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1; an empty denominator gives 0."""
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
    }


def threshold_metrics(
    df: DataFrame,
    thresholds: Sequence[float] = (0.5,),
    keys: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Counts and rates at each threshold, in one pass whatever their number."""
    counts = {}
    for i, t in enumerate(thresholds):
        counts |= confusion(F.col(score) >= F.lit(float(t)), F.col(label), str(i))
    wide = df.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")],
            )
            for i, t in enumerate(thresholds)
        ]
    )
    tall = wide.select(*keys, F.inline(rows))
    return tall.withColumns(rates(*[F.col(n) for n in ("tp", "fp", "fn", "tn")]))


def auc(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties at half credit; one class only gives null.

    Rows are first counted per score; the running number of negatives below a
    score comes from a range-partitioned sum, so no task sees a whole model.
    """
    bins = df.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    summed = running_totals(bins, [*[F.col(k) for k in keys], F.col(score)], {"upto": F.col("neg")})
    area = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    # negatives of the models sorted before this one
    start = F.min(F.col("upto") - F.col("neg"))
    p, n = F.sum("pos"), F.sum("neg")
    return summed.groupBy(*keys).agg(
        F.try_divide(area - p * start, p.cast("double") * n.cast("double")).alias("auc")
    )


def ranked_within(
    df: DataFrame, keys: Sequence[str], score: str = "score", row_id: str = "id"
) -> DataFrame:
    """Rank by descending score inside each key, ties by id, without a window per key.

    Adds ``rank`` and the key's row and positive counts ``n`` and ``positives``
    (from the column ``label``).
    """
    sums = {"n": F.count(F.lit(1)), "positives": F.count_if(F.col("label") == 1)}
    whole, carried = with_key_sums(df, keys, sums)
    order = [F.col("_row"), F.col(score).desc(), F.col(row_id)]
    return segmented_scan(whole, keys, order, {"rank": F.col("_row")}, carried).where("_row = 1").drop("_row")


def top_fraction_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    recall_fraction: float = RECALL_FRACTION,
    precision_fraction: float = PRECISION_FRACTION,
    label: str = "label",
    score: str = "score",
    row_id: str = "id",
) -> DataFrame:
    """Recall and precision in the highest-scored fraction of rows, from one ranking."""
    rows = df.select(
        *keys, F.col(label).alias("label"), F.col(score).alias("score"), F.col(row_id).alias("id")
    )
    ranked = ranked_within(rows, keys)
    k_recall, k_precision = top_count(F.col("n"), recall_fraction), top_count(F.col("n"), precision_fraction)
    hit = F.col("label") == 1
    summary = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("positives").alias("positives"),
        F.count_if(hit & (F.col("rank") <= k_recall)).alias("hits_recall"),
        F.count_if(hit & (F.col("rank") <= k_precision)).alias("hits_precision"),
    )
    n = F.coalesce("n", F.lit(0))
    return summary.select(
        *keys,
        n.alias("n"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
        ratio(F.col("hits_recall"), F.col("positives")).alias("recall_at_top_k"),
        F.when(n == 0, F.lit(0.0))
        .otherwise(ratio(F.col("hits_precision"), top_count(n, precision_fraction)))
        .alias("precision_at_top_k"),
    )


def evaluate(
    df: DataFrame,
    keys: Sequence[str] = ("model",),
    threshold: float = 0.5,
    label: str = "label",
    score: str = "score",
    row_id: str = "id",
) -> DataFrame:
    """The full metric set of each model, in long form: ``(*keys, metric, value)``."""
    keys = list(keys)
    at_threshold = threshold_metrics(df, [threshold], keys, label, score).select(
        *keys, "accuracy", "precision", "recall", "f1"
    )
    top = top_fraction_metrics(df, keys, label=label, score=score, row_id=row_id)
    wide = at_threshold.join(auc(df, keys, label, score), keys).join(
        top.select(*keys, "recall_at_top_k", "precision_at_top_k"), keys
    )
    names = ["accuracy", "auc", "f1", "precision", "recall", "recall_at_top_k", "precision_at_top_k"]
    return wide.unpivot(keys, names, "metric", "value")


def comparison(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per metric, one column per model."""
    return metrics.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def best_per_metric(metrics: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Models whose value comes within the tolerance of the metric's best."""
    top = F.max("value").over(Window.partitionBy("metric"))
    marked = metrics.withColumn("best", top)
    return marked.where(F.abs(F.col("value") - F.col("best")) < tolerance).select("metric", "model", "value")


def mean_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: mean, least and greatest of the valid values, and how many are valid or NaN."""
    kinds = dict(df.dtypes)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns if c in kinds])
    long = long.unpivot([], list(columns), "metric", "value")
    valid = F.nanvl("value", F.lit(None).cast("double"))
    return long.groupBy("metric").agg(
        F.avg(valid).alias("mean"),
        F.min(valid).alias("least"),
        F.max(valid).alias("greatest"),
        F.count(valid).alias("n_valid"),
        (F.count(F.lit(1)) - F.count(valid)).alias("n_nan"),
    )
