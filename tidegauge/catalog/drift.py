"""Drift queries: shipments before and after a date, orders by year, scores by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.catalog.base import register, scored_customers, scored_customers_sql, table
from tidegauge.operators import drift

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["o_orderstatus", "o_orderpriority"]
SPLIT = "1998-01-01"


def _sides(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return df.where(F.col(column) < cut), df.where(F.col(column) >= cut)


def _shipments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, folder, "lineitem")
    # later shipments carry a surcharge, so that one feature drifts
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    raised = F.when(F.col("l_shipdate") >= cut, F.col("l_extendedprice") * 1.25).otherwise(
        F.col("l_extendedprice")
    )
    return _sides(items.withColumn("l_extendedprice", raised), "l_shipdate")


def _psi_sql(source: str, features: list[str], side: str, slice_column: str | None = None) -> str:
    """SQL for numeric indices; ``side`` is a boolean that is true for the reference."""
    sl = slice_column or "0"
    values = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {side} AS is_ref, {sl} AS sl, CAST({f} AS DOUBLE) AS v FROM {source}"
        for f in features
    )
    return f"""
vals AS ({values}),
qs AS (SELECT feature, quantile_cont(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q
       FROM vals WHERE is_ref AND v IS NOT NULL GROUP BY feature),
edges AS (SELECT feature, list_sort(list_distinct(q)) AS e FROM qs),
placed AS (
  SELECT feature, is_ref, sl,
         CASE WHEN v < e[1] OR v > e[len(e)] THEN 0
              WHEN v = e[1] THEN 1
              ELSE len(list_filter(e, lambda x: x < v)) END AS bin
  FROM vals JOIN edges USING (feature)),
slices AS (SELECT DISTINCT feature, sl FROM placed WHERE NOT is_ref),
refs AS (SELECT s.feature, s.sl, p.bin, count(*) AS n FROM placed p JOIN slices s USING (feature)
         WHERE p.is_ref GROUP BY ALL),
curs AS (SELECT feature, sl, bin, count(*) AS n FROM placed WHERE NOT is_ref GROUP BY ALL),
grid AS (SELECT coalesce(r.feature, c.feature) AS feature, coalesce(r.sl, c.sl) AS sl,
                coalesce(r.bin, c.bin) AS bin, coalesce(r.n, 0) AS rn, coalesce(c.n, 0) AS cn
         FROM refs r FULL JOIN curs c ON r.feature = c.feature AND r.sl = c.sl AND r.bin = c.bin),
shares AS (SELECT feature, sl,
                  greatest(1e-6::DOUBLE, rn::DOUBLE / greatest(1, sum(rn) OVER (PARTITION BY feature, sl))) AS rs,
                  greatest(1e-6::DOUBLE, cn::DOUBLE / greatest(1, sum(cn) OVER (PARTITION BY feature, sl))) AS cs
           FROM grid WHERE bin > 0),
psi AS (SELECT feature, sl, sum((cs - rs) * ln(cs / rs)) AS psi FROM shares GROUP BY feature, sl)"""


_SHIPMENTS_SQL = f"""ship AS (
  SELECT l_quantity, l_discount, l_tax, l_shipdate < TIMESTAMP '{SPLIT}' AS is_ref,
         CASE WHEN l_shipdate >= TIMESTAMP '{SPLIT}' THEN l_extendedprice * 1.25::DOUBLE
              ELSE l_extendedprice END AS l_extendedprice,
         year(l_shipdate) AS yr
  FROM lineitem)"""

_BAND_SQL = "CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'ok' END"


@register(
    "drift_psi_numeric",
    f"WITH {_SHIPMENTS_SQL}, {_psi_sql('ship', NUMBERS, 'is_ref')} "
    f"SELECT feature, round(psi, 6) AS psi, {_BAND_SQL} AS status FROM psi",
)
def drift_psi_numeric(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = _shipments(spark, folder)
    psi = drift.numeric_psi(reference, current, NUMBERS)
    return psi.select(
        "feature", F.round("psi", 6).alias("psi"), drift.status_band(F.col("psi")).alias("status")
    )


_CATEGORY_SQL = f"""
cats AS (
  SELECT 'o_orderstatus' AS feature, o_orderdate < TIMESTAMP '{SPLIT}' AS is_ref,
         coalesce(o_orderstatus, '__missing__') AS bin FROM orders
  UNION ALL
  SELECT 'o_orderpriority', o_orderdate < TIMESTAMP '{SPLIT}', coalesce(o_orderpriority, '__missing__') FROM orders),
counted AS (SELECT feature, bin, count(*) FILTER (is_ref) AS rn, count(*) FILTER (NOT is_ref) AS cn
            FROM cats GROUP BY ALL),
cshares AS (SELECT feature, greatest(1e-6::DOUBLE, rn::DOUBLE / sum(rn) OVER (PARTITION BY feature)) AS rs,
                   greatest(1e-6::DOUBLE, cn::DOUBLE / sum(cn) OVER (PARTITION BY feature)) AS cs FROM counted),
cpsi AS (SELECT feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM cshares GROUP BY feature)"""


@register(
    "drift_psi_categorical",
    f"WITH {_CATEGORY_SQL} SELECT feature, round(psi, 6) AS psi FROM cpsi",
)
def drift_psi_categorical(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = _sides(table(spark, folder, "orders"), "o_orderdate")
    psi = drift.categorical_psi(reference, current, TEXTS)
    return psi.select("feature", F.round("psi", 6).alias("psi"))


_TYPED_SQL = f"""typed AS (
  SELECT o_orderpriority = '1-URGENT' AS urgent, o_orderpriority, o_custkey % 3 AS slot,
         o_orderdate < TIMESTAMP '{SPLIT}' AS is_ref FROM orders)"""
_TYPED_CATEGORY_SQL = """
cats AS (SELECT 'o_orderpriority' AS feature, is_ref, o_orderpriority AS bin FROM typed
         UNION ALL SELECT 'slot', is_ref, slot::VARCHAR FROM typed),
""" + _CATEGORY_SQL[_CATEGORY_SQL.index("counted AS"):]


@register(
    "drift_psi_types",
    f"""WITH {_TYPED_SQL}, {_psi_sql('typed', ['urgent'], 'is_ref')}, {_TYPED_CATEGORY_SQL}
SELECT feature, round(psi, 6) AS psi FROM psi UNION ALL SELECT feature, round(psi, 6) FROM cpsi""",
)
def drift_psi_types(spark: SparkSession, folder: str) -> DataFrame:
    """A boolean is binned as a number; a timestamp and a text are compared value by value."""
    slot = F.timestamp_add("DAY", (F.col("o_custkey") % 3).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    reference, current = _sides(
        table(spark, folder, "orders").withColumns({"urgent": F.col("o_orderpriority") == "1-URGENT", "slot": slot}),
        "o_orderdate",
    )
    psi = drift.feature_psi(reference, current, ["urgent", "slot", "o_orderpriority"])
    return psi.select("feature", F.round("psi", 6).alias("psi"))


@register(
    "drift_decision",
    f"""WITH {_SHIPMENTS_SQL}, {_psi_sql('ship', NUMBERS, 'is_ref')}, {_CATEGORY_SQL},
every AS (SELECT feature, psi FROM psi UNION ALL SELECT feature, psi FROM cpsi)
SELECT CASE WHEN max(psi) >= 0.2 THEN 'critical' WHEN max(psi) >= 0.1 THEN 'warning' ELSE 'ok' END AS status,
       round(max(psi), 6) AS max_feature_psi, round(avg(psi), 6) AS mean_feature_psi,
       round(count(*) FILTER (psi >= 0.1)::DOUBLE / count(*), 6) AS drifted_feature_share,
       coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi >= 0.1), '') AS drifted_features,
       string_agg(feature || '=' || printf('%.4f', psi), ',' ORDER BY feature) AS feature_psi
FROM every""",
)
def drift_decision(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = _shipments(spark, folder)
    numbers = drift.numeric_psi(reference, current, NUMBERS)
    before, after = _sides(table(spark, folder, "orders"), "o_orderdate")
    decision = drift.decide(numbers.unionByName(drift.categorical_psi(before, after, TEXTS)))
    pairs = F.transform(
        F.map_entries("feature_psi"), lambda e: F.format_string("%s=%.4f", e["key"], e["value"])
    )
    return decision.select(
        "status",
        F.round("max_feature_psi", 6).alias("max_feature_psi"),
        F.round("mean_feature_psi", 6).alias("mean_feature_psi"),
        F.round("drifted_feature_share", 6).alias("drifted_feature_share"),
        F.array_join("drifted_features", ",").alias("drifted_features"),
        F.array_join(pairs, ",").alias("feature_psi"),
    )



@register(
    "drift_min_sample",
    f"""WITH {_SHIPMENTS_SQL}, {_psi_sql('ship', NUMBERS, 'is_ref', 'yr')},
sizes AS (SELECT yr AS sl, count(*) AS n, (SELECT count(*) FROM ship) // 8 AS least FROM ship WHERE NOT is_ref GROUP BY yr)
SELECT CAST(sl AS INTEGER) AS year, n AS current_row_count,
       CASE WHEN n < any_value(least) THEN 'insufficient_data' WHEN max(psi) >= 0.2 THEN 'critical'
            WHEN max(psi) >= 0.1 THEN 'warning' ELSE 'ok' END AS status,
       n >= any_value(least) AS decision_eligible,
       n >= any_value(least) AND max(psi) >= 0.2 AS retraining_recommended,
       round(max(psi), 6) AS max_feature_psi
FROM psi JOIN sizes USING (sl) GROUP BY sl, n""",
)
def drift_min_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One decision per year of shipping; years below an eighth of all rows are withheld."""
    reference, current = _shipments(spark, folder)
    current = current.withColumn("year", F.year("l_shipdate"))
    least = table(spark, folder, "lineitem").count() // 8
    decision = drift.decide(drift.numeric_psi(reference, current, NUMBERS, keys=["year"]), keys=["year"])
    sizes = current.groupBy("year").agg(F.count(F.lit(1)).alias("current_row_count"))
    checked = drift.apply_minimum_sample(
        decision.join(sizes, "year"), F.col("current_row_count"), least
    )
    return checked.select(
        "year", "current_row_count", "status", "decision_eligible", "retraining_recommended",
        F.round("max_feature_psi", 6).alias("max_feature_psi"),
    )


@register(
    "prediction_psi",
    f"""WITH {scored_customers_sql()},
halves AS (SELECT champion, challenger, third, "CustomerId" % 3 > 0 AS is_ref FROM scored),
{_psi_sql('halves', ['champion', 'challenger', 'third'], 'is_ref')}
SELECT feature AS model, round(psi, 6) AS prediction_psi FROM psi""",
)
def prediction_psi(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_customers(spark, folder)
    models = ["champion", "challenger", "third"]
    reference = scored.where(F.col("CustomerId") % 3 > 0)
    current = scored.where(F.col("CustomerId") % 3 == 0)
    psi = drift.numeric_psi(reference, current, models)
    return psi.select(F.col("feature").alias("model"), F.round("psi", 6).alias("prediction_psi"))


@register(
    "dataset_drift_share",
    f"""WITH {_SHIPMENTS_SQL}, {_psi_sql('ship', NUMBERS, 'is_ref')}
SELECT count(*) AS n_features, count(*) FILTER (psi >= 0.1) AS n_drifted,
       count(*) FILTER (psi >= 0.1)::DOUBLE / count(*) AS drifted_share,
       count(*) FILTER (psi >= 0.1)::DOUBLE / count(*) >= 1.0 / count(*) AS dataset_drift
FROM psi""",
)
def dataset_drift_share(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = _shipments(spark, folder)
    return drift.dataset_drift(drift.numeric_psi(reference, current, NUMBERS))
