"""Registry of named queries, and the inputs they derive from the given tables.

Each query has a DataFrame form and, where SQL can express it, a plain SQL twin
over the same tables. The churn-shaped tables are derived from ``customer`` and
``orders``, so that every query grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.session import pin_runtime, spread

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFunction
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query under a name with its SQL twin."""

    def add(run: QueryFunction) -> QueryFunction:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return pin_runtime(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables for costly text work, over all cores even when small."""
    return spread(table(spark, folder, name))


def moment(column: str | Column) -> Column:
    """Zoneless timestamp as a timestamp of the session zone (UTC)."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp")


# --- customers in the layout of the raw contract ---------------------------


def raw_customers(spark: SparkSession, folder: str, clean: bool = True) -> DataFrame:
    """Customers with their order history in the 18-column layout.

    With ``clean=False`` balances stay as recorded, some of them negative.
    """
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    history = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.max("o_totalprice").alias("top"),
        F.max("o_orderdate").alias("last"),
    )
    joined = customer.join(history, customer["c_custkey"] == history["o_custkey"], "left")
    key, n = F.col("c_custkey"), F.coalesce("n", F.lit(0))
    balance = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.lit(20.0) if clean else F.col("c_acctbal")

    def pick(names: list[str], place: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in names]), place.cast("int"))

    frame = joined.select(
        key.alias("RowNumber"),
        key.alias("CustomerId"),
        F.col("c_name").alias("Surname"),
        (F.lit(300) + F.floor((F.col("c_acctbal") + 1000) / 20)).cast("long").alias("CreditScore"),
        pick(["France", "Germany", "Spain"], F.col("c_nationkey") % 3).alias("Geography"),
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.lit("Female"))
        .otherwise(F.lit("Male")).alias("Gender"),
        (F.lit(18) + (key * 7919) % 83).cast("long").alias("Age"),
        (n % 11).cast("long").alias("Tenure"),
        balance.alias("Balance"),
        (F.lit(1) + F.coalesce("urgent", F.lit(0)) % 4).cast("long").alias("NumOfProducts"),
        (n % 2).cast("long").alias("HasCrCard"),
        F.when(F.col("last") >= F.lit("2001-06-01").cast("timestamp_ntz"), 1).otherwise(0)
        .cast("long").alias("IsActiveMember"),
        (F.coalesce("top", F.lit(0.0)) + F.lit(11.58)).alias("EstimatedSalary"),
        (F.lit(1) + key % 5).cast("long").alias("Satisfaction Score"),
        pick(["SILVER", "GOLD", "PLATINUM", "DIAMOND"], F.least(F.lit(3), F.floor(n / 6))).alias("Card Type"),
        ((n * 37 + key % 100) % 1001).cast("long").alias("Point Earned"),
        F.col("c_acctbal"),
    )
    left = (
        ((F.col("Age") >= 62) & (F.col("NumOfProducts") != 2))
        | ((F.col("IsActiveMember") == 0) & (F.col("c_acctbal") < 500))
        | (F.col("CustomerId") % 13 == 0)
    )
    frame = frame.withColumn("Exited", F.when(left, 1).otherwise(0).cast("long"))
    complained = (F.col("Exited") == 1) & (F.col("CustomerId") % 5 != 0)
    frame = frame.withColumn("Complain", F.when(complained, 1).otherwise(0).cast("long"))
    return frame.select(
        "RowNumber", "CustomerId", "Surname", "CreditScore", "Geography", "Gender", "Age", "Tenure",
        "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary", "Exited",
        "Complain", "Satisfaction Score", "Card Type", "Point Earned",
    )


def raw_customers_sql(clean: bool = True) -> str:
    """The WITH parts that give ``raw``, the twin of :func:`raw_customers`."""
    balance = "greatest(c_acctbal, 0.0) * 20.0" if clean else "c_acctbal"
    return f"""
history AS (
  SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
         max(o_totalprice) AS top, max(o_orderdate) AS last
  FROM orders GROUP BY o_custkey),
raw0 AS (
  SELECT c_custkey AS "RowNumber", c_custkey AS "CustomerId", c_name AS "Surname",
         300 + CAST(floor((c_acctbal + 1000) / 20) AS BIGINT) AS "CreditScore",
         ['France', 'Germany', 'Spain'][c_nationkey % 3 + 1] AS "Geography",
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Female' ELSE 'Male' END AS "Gender",
         18 + (c_custkey * 7919) % 83 AS "Age",
         coalesce(n, 0) % 11 AS "Tenure",
         {balance} AS "Balance",
         1 + coalesce(urgent, 0) % 4 AS "NumOfProducts",
         coalesce(n, 0) % 2 AS "HasCrCard",
         CASE WHEN last >= TIMESTAMP '2001-06-01' THEN 1 ELSE 0 END AS "IsActiveMember",
         coalesce(top, 0.0) + 11.58 AS "EstimatedSalary",
         1 + c_custkey % 5 AS "Satisfaction Score",
         ['SILVER', 'GOLD', 'PLATINUM', 'DIAMOND'][least(3, coalesce(n, 0) // 6) + 1] AS "Card Type",
         (coalesce(n, 0) * 37 + c_custkey % 100) % 1001 AS "Point Earned",
         c_acctbal
  FROM customer LEFT JOIN history ON c_custkey = o_custkey),
raw1 AS (
  SELECT *, CASE WHEN ("Age" >= 62 AND "NumOfProducts" <> 2) OR ("IsActiveMember" = 0 AND c_acctbal < 500)
                   OR "CustomerId" % 13 = 0 THEN 1 ELSE 0 END AS "Exited"
  FROM raw0),
raw AS (
  SELECT *, CASE WHEN "Exited" = 1 AND "CustomerId" % 5 <> 0 THEN 1 ELSE 0 END AS "Complain"
  FROM raw1)"""


# --- customers with two fixed scores ---------------------------------------

# Weights of (age, products, active, credit score, offset) for two scores.
SCORE_WEIGHTS = {
    "champion": (0.035, 0.4, 0.8, 400.0, -1.2),
    "challenger": (0.060, -0.1, 1.1, 250.0, -1.0),
    "third": (0.010, 0.9, 0.1, 900.0, -0.9),
}


def scored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Id, label and one probability per fixed score, with the drift features."""
    raw = raw_customers(spark, folder)
    scores = {}
    for name, (age, products, active, credit, offset) in SCORE_WEIGHTS.items():
        z = (
            F.lit(offset)
            + F.lit(age) * (F.col("Age") - 50)
            + F.lit(products) * (F.col("NumOfProducts") - 2)
            - F.lit(active) * F.col("IsActiveMember")
            - (F.col("CreditScore") - 575) / F.lit(credit)
        )
        scores[name] = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)
    return raw.select("CustomerId", F.col("Exited").alias("label"), *[c.alias(n) for n, c in scores.items()])


def scored_customers_sql() -> str:
    """The WITH parts that give ``scored``."""
    columns = []
    for name, (age, products, active, credit, offset) in SCORE_WEIGHTS.items():
        z = (
            f'({offset} + {age}::DOUBLE * ("Age" - 50) + ({products})::DOUBLE * ("NumOfProducts" - 2) '
            f'- {active}::DOUBLE * "IsActiveMember" - ("CreditScore" - 575) / {credit}::DOUBLE)'
        )
        columns.append(f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-{z})), 6) AS {name}")
    return f"""{raw_customers_sql()},
scored AS (SELECT "CustomerId", "Exited" AS label, {", ".join(columns)} FROM raw)"""


def long_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and score: ``(model, CustomerId, label, score)``."""
    return scored_customers(spark, folder).unpivot(
        ["CustomerId", "label"], list(SCORE_WEIGHTS), "model", "score"
    )


def long_scores_sql() -> str:
    """The WITH parts that give ``scores``."""
    parts = [
        f"SELECT '{name}' AS model, \"CustomerId\", label, {name} AS score FROM scored"
        for name in SCORE_WEIGHTS
    ]
    return f"{scored_customers_sql()},\nscores AS ({' UNION ALL '.join(parts)})"
