"""Contracts, cleaning, encoding, splits and enrichment over the derived customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schemas
from tidegauge.catalog.base import moment, raw_customers, raw_customers_sql, register, table
from tidegauge.functions import dates, hashing, numeric
from tidegauge.operators import cleaning, contracts
from tidegauge.operators.encoder import ChurnEncoder

_DIRTY = raw_customers_sql(clean=False)
_CLEAN = raw_customers_sql()


def _checks_sql(columns: list[str], rules: list[tuple[str, str, str]]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", 'dtype' AS rule, 0 AS n_violations" for c in columns]
    parts += [
        f"SELECT '{c}', 'not_null', count(*) FILTER (\"{c}\" IS NULL) FROM raw" for c in columns
    ]
    parts += [f"SELECT '{c}', '{r}', count(*) FILTER (NOT ({cond})) FROM raw" for c, r, cond in rules]
    return " UNION ALL ".join(parts)


_RULES_SQL = [
    ("CreditScore", "in_range", '"CreditScore" BETWEEN 300 AND 850'),
    ("Geography", "isin", "\"Geography\" IN ('France', 'Germany', 'Spain')"),
    ("Gender", "isin", "\"Gender\" IN ('Female', 'Male')"),
    ("Age", "in_range", '"Age" BETWEEN 18 AND 100'),
    ("Tenure", "in_range", '"Tenure" BETWEEN 0 AND 10'),
    ("Balance", "greater_than_or_equal_to", '"Balance" >= 0'),
    ("NumOfProducts", "in_range", '"NumOfProducts" BETWEEN 1 AND 4'),
    ("HasCrCard", "isin", '"HasCrCard" IN (0, 1)'),
    ("IsActiveMember", "isin", '"IsActiveMember" IN (0, 1)'),
    ("EstimatedSalary", "greater_than", '"EstimatedSalary" > 0'),
    ("Exited", "isin", '"Exited" IN (0, 1)'),
    ("Complain", "isin", '"Complain" IN (0, 1)'),
    ("Satisfaction Score", "in_range", '"Satisfaction Score" BETWEEN 1 AND 5'),
    ("Card Type", "isin", "\"Card Type\" IN ('SILVER', 'GOLD', 'PLATINUM', 'DIAMOND')"),
    ("Point Earned", "greater_than_or_equal_to", '"Point Earned" >= 0'),
]


@register(
    "contract_report_raw",
    f"WITH {_DIRTY} " + _checks_sql(schemas.RAW_CUSTOMERS.names, _RULES_SQL),
)
def contract_report_raw(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_customers(spark, folder, clean=False)
    return contracts.contract_report(raw, schemas.RAW_CUSTOMERS, contracts.RAW_RULES)


@register(
    "contract_report_interim",
    f"WITH {_CLEAN} " + _checks_sql(schemas.INTERIM_CUSTOMERS.names, _RULES_SQL),
)
def contract_report_interim(spark: SparkSession, folder: str) -> DataFrame:
    interim = contracts.require_no_identifiers(contracts.drop_identifiers(raw_customers(spark, folder)))
    return contracts.contract_report(interim, schemas.INTERIM_CUSTOMERS, contracts.INTERIM_RULES)


@register(
    "incomplete_feature_rows",
    """SELECT count(*) FILTER (l_quantity IS NULL OR l_extendedprice IS NULL OR l_discount IS NULL
                               OR price_per_discount IS NULL) AS n_incomplete
       FROM (SELECT *, l_extendedprice / nullif(l_discount, 0) AS price_per_discount FROM lineitem)""",
)
def incomplete_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").withColumn(
        "price_per_discount", F.try_divide("l_extendedprice", "l_discount")
    )
    return contracts.incomplete_rows(
        items, ["l_quantity", "l_extendedprice", "l_discount", "price_per_discount"]
    )


# --- requests ---------------------------------------------------------------


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request rows with gaps and faults, from the recorded customers."""
    raw = raw_customers(spark, folder, clean=False)
    return raw.select(
        F.col("RowNumber").alias("index"),
        (F.col("CreditScore") + F.when(F.col("RowNumber") % 11 == 0, 400).otherwise(0)).alias("CreditScore"),
        F.when(F.col("RowNumber") % 17 == 0, "Atlantis").otherwise(F.col("Geography")).alias("Geography"),
        F.when(F.col("RowNumber") % 7 > 0, F.col("Gender")).alias("Gender"),
        (F.col("Age") - F.when(F.col("RowNumber") % 19 == 0, 90).otherwise(0)).alias("Age"),
        "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary", "Card Type",
        F.when(F.col("RowNumber") % 23 == 0, F.lit(" RF-v2 "))
        .when(F.col("RowNumber") % 29 == 0, F.lit("RF_V2"))
        .alias("model_name"),
    )


_REQUESTS_SQL = f"""{_DIRTY},
req AS (
  SELECT "RowNumber" AS "index",
         "CreditScore" + CASE WHEN "RowNumber" % 11 = 0 THEN 400 ELSE 0 END AS cs,
         CASE WHEN "RowNumber" % 17 = 0 THEN 'Atlantis' ELSE "Geography" END AS geo,
         CASE WHEN "RowNumber" % 7 > 0 THEN "Gender" ELSE 'Female' END AS gender,
         "Age" - CASE WHEN "RowNumber" % 19 = 0 THEN 90 ELSE 0 END AS age, "Balance" AS bal,
         CASE WHEN "RowNumber" % 23 = 0 THEN 'rf-v2' WHEN "RowNumber" % 29 = 0 THEN 'rf_v2' ELSE 'current' END AS model_name
  FROM raw),
checked AS (
  SELECT "index", gender, model_name, list_filter([
    CASE WHEN cs < 0 THEN 'CreditScore: Input should be greater than or equal to 0'
         WHEN cs > 850 THEN 'CreditScore: Input should be less than or equal to 850' END,
    CASE WHEN geo = 'Atlantis' THEN 'Geography: Value error, Geography deve ser um de [''France'', ''Germany'', ''Spain'']' END,
    CASE WHEN age < 18 THEN 'Age: Input should be greater than or equal to 18'
         WHEN age > 100 THEN 'Age: Input should be less than or equal to 100' END,
    CASE WHEN bal < 0 THEN 'Balance: Input should be greater than or equal to 0' END,
    CASE WHEN model_name = 'rf-v2' THEN 'model_name: Value error, model_name deve conter apenas letras minúsculas, números e underscore' END
  ], lambda x: x IS NOT NULL) AS errors FROM req)"""


@register(
    "row_validation",
    f"""WITH {_REQUESTS_SQL}
SELECT "index", gender AS "Gender", model_name, CASE WHEN len(errors) = 0 THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN len(errors) > 0 THEN array_to_string(errors, '; ') END AS error, 5 AS "Tenure"
FROM checked""",
)
def row_validation(spark: SparkSession, folder: str) -> DataFrame:
    checked = contracts.validate_requests(_requests(spark, folder))
    return checked.select("index", "Gender", "model_name", "status", "error", "Tenure")


@register(
    "batch_summary",
    f"""WITH {_REQUESTS_SQL}
SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS success,
       count(*) FILTER (len(errors) > 0) AS errors FROM checked""",
)
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.batch_summary(contracts.validate_requests(_requests(spark, folder)))


@register(
    "lookup_validation",
    """WITH req AS (SELECT event_id AS "index", user_id - 3 AS customer_id, lower(trim(event_type)) AS model_name FROM events)
SELECT "index", customer_id, model_name, CASE WHEN customer_id > 0 THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN customer_id <= 0 THEN 'customer_id: Input should be greater than 0' END AS error FROM req""",
)
def lookup_validation(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "events").select(
        F.col("event_id").alias("index"),
        (F.col("user_id") - 3).alias("customer_id"),
        F.upper("event_type").alias("model_name"),
    )
    checked = contracts.validate_lookups(requests)
    return checked.select("index", "customer_id", "model_name", "status", "error")


# --- cleaning ---------------------------------------------------------------


@register(
    "clean_report",
    """WITH src AS (SELECT o_custkey, o_orderstatus, o_orderpriority,
                           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END AS yr FROM orders),
uniq AS (SELECT DISTINCT * FROM src)
SELECT (SELECT count(*) FROM src) AS rows_in,
       (SELECT count(*) FROM src) - (SELECT count(*) FROM uniq) AS duplicates_removed,
       count(*) FILTER (yr IS NULL) AS missing_removed, count(*) FILTER (yr IS NOT NULL) AS rows_out FROM uniq""",
)
def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("yr"),
    )
    return cleaning.clean_report(orders)


@register(
    "dedup_order",
    """SELECT 'minimised_first' AS way, count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, year(o_orderdate) FROM orders)
UNION ALL SELECT 'identifiers_kept', count(*) FROM (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate) FROM orders)""",
)
def dedup_order(spark: SparkSession, folder: str) -> DataFrame:
    """Equal customers collapse only when identifiers go before the duplicates."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("yr")
    )
    first = cleaning.drop_duplicates(contracts.drop_identifiers(orders, ["o_orderkey"]))
    kept = contracts.drop_identifiers(cleaning.drop_duplicates(orders), ["o_orderkey"])
    count = F.count(F.lit(1)).alias("n")
    return first.agg(count).select(F.lit("minimised_first").alias("way"), "n").unionByName(
        kept.agg(count).select(F.lit("identifiers_kept").alias("way"), "n")
    )


@register(
    "content_fingerprint",
    """WITH marked AS (
  SELECT ('0x' || substr(md5(concat_ws(chr(1), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)), 1, 15))::BIGINT AS h
  FROM orders)
SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(h % 1000003) AS BIGINT) AS sum_hash FROM marked""",
)
def content_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.content_fingerprint(
        table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    )


# --- encoding ---------------------------------------------------------------

_BASE_FEATURES = """base AS (
  SELECT "CustomerId",
         coalesce(list_position(['SILVER', 'GOLD', 'PLATINUM', 'DIAMOND'], "Card Type"), 0) - 1 AS card,
         coalesce(list_position(['Female', 'Male'], "Gender"), 0) - 1 AS gender,
         CASE WHEN "Geography" = 'Germany' THEN 1.0 ELSE 0.0 END AS ger,
         CASE WHEN "Geography" = 'Spain' THEN 1.0 ELSE 0.0 END AS spa,
         "CreditScore"::DOUBLE AS f1, "Age"::DOUBLE AS f2, "Tenure"::DOUBLE AS f3, "Balance"::DOUBLE AS f4,
         "NumOfProducts"::DOUBLE AS f5, "HasCrCard"::DOUBLE AS f6, "IsActiveMember"::DOUBLE AS f7,
         "EstimatedSalary"::DOUBLE AS f8, "Point Earned"::DOUBLE AS f9,
         "Balance" / CASE WHEN "NumOfProducts" = 0 THEN 1 ELSE "NumOfProducts" END AS f10,
         "Point Earned" / ("EstimatedSalary" + 1.0::DOUBLE) AS f11
  FROM raw)"""
_SCALED_NAMES = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
    "EstimatedSalary", "Point Earned", "BalancePerProduct", "PointsPerSalary",
]


def _scaled_sql(column: str) -> str:
    return (
        f"round(({column} - avg({column}) OVER ()) / "
        f"CASE WHEN stddev_pop({column}) OVER () = 0 THEN 1 ELSE stddev_pop({column}) OVER () END, 6)"
    )


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


@register(
    "encode_features",
    f"""WITH {_CLEAN}, {_BASE_FEATURES}
SELECT "CustomerId", card::DOUBLE AS "Card Type", gender::DOUBLE AS "Gender", ger::DOUBLE AS "Geo_Germany", spa::DOUBLE AS "Geo_Spain",
       {", ".join(f'{_scaled_sql(f"f{i + 1}")} AS "{n}"' for i, n in enumerate(_SCALED_NAMES))}
FROM base""",
)
def encode_features(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_customers(spark, folder)
    model = ChurnEncoder(passthrough=["CustomerId"]).fit(raw)
    return _rounded(model.transform(raw), schemas.FEATURES)


@register(
    "encode_features_exploratory",
    f"""WITH {_CLEAN}, {_BASE_FEATURES}, coded AS (SELECT * REPLACE (card + 1 AS card) FROM base)
SELECT "CustomerId", {_scaled_sql('card')} AS "Card Type", {_scaled_sql('gender')} AS "Gender",
       {_scaled_sql('ger')} AS "Geo_Germany", {_scaled_sql('spa')} AS "Geo_Spain",
       {", ".join(f'{_scaled_sql(f"f{i + 1}")} AS "{n}"' for i, n in enumerate(_SCALED_NAMES))}
FROM coded""",
)
def encode_features_exploratory(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_customers(spark, folder)
    model = ChurnEncoder(variant="exploratory", passthrough=["CustomerId"]).fit(raw)
    return _rounded(model.transform(raw), schemas.FEATURES)


@register(
    "scaler_parameters",
    f"WITH {_CLEAN}, {_BASE_FEATURES} "
    + " UNION ALL ".join(
        f"SELECT {i} AS place, '{n}' AS feature, round(avg(f{i + 1}), 6) AS mean, "
        f"round(stddev_pop(f{i + 1}), 6) AS deviation FROM base"
        for i, n in enumerate(_SCALED_NAMES)
    ),
)
def scaler_parameters(spark: SparkSession, folder: str) -> DataFrame:
    model = ChurnEncoder().fit(raw_customers(spark, folder))
    return _rounded(model.parameters(spark), ["mean", "deviation"])


@register(
    "clip_values",
    """SELECT l_orderkey, l_linenumber,
       CAST(greatest(10, least(40, round_even(l_quantity * 1.5::DOUBLE, 0))) AS INTEGER) AS quantity,
       least(greatest(l_extendedprice, 5000.0), 40000.0) AS price,
       CASE WHEN l_discount >= 0.05::DOUBLE THEN 1 ELSE 0 END AS discounted
FROM lineitem""",
)
def clip_values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numeric.clip_int(F.col("l_quantity") * 1.5, 10, 40).alias("quantity"),
        numeric.clip_float(F.col("l_extendedprice"), 5000.0, 40000.0).alias("price"),
        numeric.threshold_class(F.col("l_discount"), 0.05).alias("discounted"),
    )


# --- split ------------------------------------------------------------------


@register(
    "stratified_split",
    """WITH drawn AS (
  SELECT o_orderkey, o_orderstatus,
         ('0x' || substr(md5(o_orderkey::VARCHAR || '|42|split'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM orders),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) AS rn,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM drawn)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM placed""",
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return cleaning.stratified_split(orders, "o_orderstatus", "o_orderkey")


@register(
    "stratified_split_customers",
    """WITH drawn AS (
  SELECT o_orderkey, o_custkey,
         ('0x' || substr(md5(o_orderkey::VARCHAR || '|42|split'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM orders),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY u, o_orderkey) AS rn,
                  count(*) OVER (PARTITION BY o_custkey) AS n FROM drawn)
SELECT o_orderkey, o_custkey, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM placed""",
)
def stratified_split_customers(spark: SparkSession, folder: str) -> DataFrame:
    """A split by a target of very many values."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return cleaning.stratified_split(orders, "o_custkey", "o_orderkey")


@register(
    "class_rate",
    """WITH drawn AS (
  SELECT doc_id, quality,
         ('0x' || substr(md5(doc_id::VARCHAR || '|42|split'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM labels),
placed AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY u, doc_id) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n FROM drawn)
SELECT CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       count(*) FILTER (quality = 1) AS n_positive, round(avg(quality), 6) AS positive_rate
FROM placed GROUP BY 1""",
)
def class_rate(spark: SparkSession, folder: str) -> DataFrame:
    split = cleaning.stratified_split(table(spark, folder, "labels"), "quality", "doc_id")
    return _rounded(cleaning.class_rates(split, "quality", ["split"]), ["positive_rate"])


@register(
    "neg_pos_ratio",
    f"""WITH {_CLEAN}
SELECT count(*) FILTER ("Exited" = 0) AS n_negative, count(*) FILTER ("Exited" = 1) AS n_positive,
       round(count(*) FILTER ("Exited" = 0)::DOUBLE / greatest(1, count(*) FILTER ("Exited" = 1)), 6) AS neg_pos_ratio
FROM raw""",
)
def neg_pos_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(cleaning.imbalance_ratio(raw_customers(spark, folder), "Exited"), ["neg_pos_ratio"])


# --- generated columns ------------------------------------------------------

@register(
    "customer_since",
    f"""WITH {_CLEAN},
halves AS (SELECT "CustomerId", "Tenure", md5("CustomerId"::VARCHAR) AS h FROM raw),
words AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b,
                 ('0x' || substr(h, 17, 8))::BIGINT AS c, ('0x' || substr(h, 25, 8))::BIGINT AS d FROM halves)
SELECT "CustomerId",
       CAST(((a::HUGEINT * 4294967296 + b) % 365 * (18446744073709551616::HUGEINT % 365) + (c::HUGEINT * 4294967296 + d) % 365) % 365 AS INTEGER) AS offset_days,
       strftime(CAST(DATE '2024-12-31' - to_years(CAST("Tenure" AS INTEGER)) AS DATE) +
         CAST(((a::HUGEINT * 4294967296 + b) % 365 * (18446744073709551616::HUGEINT % 365) + (c::HUGEINT * 4294967296 + d) % 365) % 365 AS INTEGER), '%Y-%m-%d') AS customer_since_date
FROM words""",
)
def customer_since(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_customers(spark, folder)
    return raw.select(
        "CustomerId",
        hashing.md5_mod(F.col("CustomerId").cast("string"), 365).cast("int").alias("offset_days"),
        dates.customer_since(F.col("CustomerId"), F.col("Tenure")).alias("customer_since_date"),
    )


@register(
    "snapshot_dates",
    """SELECT c_custkey, strftime(DATE '2024-01-01' + CAST((c_custkey - 1 + 365) % 365 AS INTEGER), '%Y-%m-%d') AS snapshot_date,
       strftime(DATE '2024-01-01' + CAST((c_custkey - 1 + 365) % 365 AS INTEGER), '%Y-%m-%d') AS materialized_at FROM customer""",
)
def snapshot_dates(spark: SparkSession, folder: str) -> DataFrame:
    snapshot = dates.snapshot_date(F.col("c_custkey"), cycle_days=365)
    return table(spark, folder, "customer").select(
        "c_custkey", snapshot.alias("snapshot_date"), snapshot.alias("materialized_at")
    )


@register(
    "generation_metadata",
    """WITH after_ AS (SELECT strftime(DATE '2024-01-01' + CAST((c_custkey - 1 + 365) % 365 AS INTEGER), '%Y-%m-%d') AS snapshot_date FROM customer)
SELECT count(*) AS rows_before, count(*) AS rows_after, 5 AS columns_before, 7 AS columns_after,
       'snapshot_date,materialized_at' AS added_columns, min(snapshot_date) AS snapshot_date_min, max(snapshot_date) AS snapshot_date_max,
       min(snapshot_date) AS materialized_at_min, max(snapshot_date) AS materialized_at_max FROM after_""",
)
def generation_metadata(spark: SparkSession, folder: str) -> DataFrame:
    before = table(spark, folder, "customer")
    snapshot = dates.snapshot_date(F.col("c_custkey"), cycle_days=365)
    after = before.withColumns({"snapshot_date": snapshot, "materialized_at": snapshot})
    return cleaning.generation_metadata(before, after, ["snapshot_date", "materialized_at"])


@register(
    "local_timestamps",
    """SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS local_time FROM events""",
)
def local_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", dates.iso_with_offset(moment("ts")).alias("local_time")
    )
