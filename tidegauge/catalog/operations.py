"""Operational metrics: events as requests, their value as latency, 'error' as failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.catalog.base import moment, register, table
from tidegauge.operators import opsmetrics

BOUNDS = opsmetrics.LATENCY_BOUNDS["predict"]
_STAMP = "%Y-%m-%d %H:%M:%S"


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the layout of request logs."""
    return as_requests(table(spark, folder, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    """A table or stream of events in that layout."""
    return events.select(
        "event_id",
        moment("ts").alias("ts"),
        F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("user_id") % 2 == 0, "POST").otherwise("GET").alias("method"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status_code"),
        (F.col("value") / 100.0).alias("latency_s"),
    )


_REQUESTS_SQL = """req AS (
  SELECT event_id, ts, '/' || event_type AS endpoint, CASE WHEN user_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
         CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status_code, value / 100.0::DOUBLE AS latency_s FROM events)"""
_SLIDES_SQL = """slid AS (
  SELECT req.*, date_trunc('minute', ts) - to_minutes(i) AS ws FROM req CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i))"""


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@register(
    "request_counters",
    f"WITH {_REQUESTS_SQL} SELECT method, status_code, count(*) AS requests FROM req GROUP BY ALL",
)
def request_counters(spark: SparkSession, folder: str) -> DataFrame:
    return opsmetrics.request_counts(requests(spark, folder), ["method", "status_code"])


@register(
    "latency_histogram",
    f"WITH {_REQUESTS_SQL} "
    + " UNION ALL ".join(
        f"SELECT endpoint, '{b}' AS le, count(*) FILTER (latency_s <= {b}::DOUBLE) AS cumulative FROM req GROUP BY endpoint"
        for b in BOUNDS
    )
    + " UNION ALL SELECT endpoint, '+Inf', count(*) FROM req GROUP BY endpoint",
)
def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return opsmetrics.latency_histogram(requests(spark, folder), BOUNDS, ["endpoint"])


def _quantile_sql() -> str:
    cases = []
    for i, b in enumerate(BOUNDS):
        low, below = (BOUNDS[i - 1], f"le_{i - 1}") if i else (0.0, "0")
        cases.append(
            f"WHEN le_{i} >= 0.95::DOUBLE * n THEN {low}::DOUBLE + ({b}::DOUBLE - {low}::DOUBLE) * "
            f"(0.95::DOUBLE * n - {below}) / (le_{i} - {below})"
        )
    return f"CASE {' '.join(cases)} ELSE {BOUNDS[-1]}::DOUBLE END"


@register(
    "latency_p95_sliding",
    f"""WITH {_REQUESTS_SQL}, {_SLIDES_SQL},
counted AS (SELECT ws, count(*) AS n, {", ".join(f"count(*) FILTER (latency_s <= {b}::DOUBLE) AS le_{i}" for i, b in enumerate(BOUNDS))} FROM slid GROUP BY ws)
SELECT strftime(ws, '{_STAMP}') AS window_start, n AS requests, round({_quantile_sql()}, 6) AS p95 FROM counted""",
)
def latency_p95_sliding(spark: SparkSession, folder: str) -> DataFrame:
    found = opsmetrics.latency_p95(requests(spark, folder), BOUNDS)
    return _stamped(found).withColumn("p95", F.round("p95", 6))


@register(
    "latency_p95_exact",
    f"""WITH {_REQUESTS_SQL}
SELECT endpoint, strftime(date_trunc('hour', ts), '{_STAMP}') AS window_start, count(*) AS requests,
       round(quantile_cont(latency_s, 0.95), 6) AS p95 FROM req GROUP BY endpoint, date_trunc('hour', ts)""",
)
def latency_p95_exact(spark: SparkSession, folder: str) -> DataFrame:
    found = opsmetrics.latency_p95_exact(requests(spark, folder), ["endpoint"])
    return _stamped(found).withColumn("p95", F.round("p95", 6))


@register(
    "request_rate",
    f"""WITH {_REQUESTS_SQL}
SELECT endpoint, strftime(date_trunc('minute', ts), '{_STAMP}') AS window_start, count(*) AS requests, count(*)::DOUBLE AS per_minute
FROM req GROUP BY endpoint, date_trunc('minute', ts)""",
)
def request_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _stamped(opsmetrics.request_rate(requests(spark, folder), ["endpoint"]))


@register(
    "error_share",
    f"""WITH {_REQUESTS_SQL}, {_SLIDES_SQL}
SELECT strftime(ws, '{_STAMP}') AS window_start, count(*) AS requests, count(*) FILTER (status_code LIKE '5%') AS errors,
       round(count(*) FILTER (status_code LIKE '5%')::DOUBLE / count(*), 6) AS error_share FROM slid GROUP BY ws""",
)
def error_share(spark: SparkSession, folder: str) -> DataFrame:
    found = opsmetrics.error_share(requests(spark, folder), F.col("status_code").startswith("5"))
    return _stamped(found).withColumn("error_share", F.round("error_share", 6))


def phases(spark: SparkSession, folder: str) -> DataFrame:
    """A start and a finish row per request; the recorded value is its length in seconds."""
    return as_phases(table(spark, folder, "events").withColumn("ts", moment("ts")))


def as_phases(events: DataFrame) -> DataFrame:
    """Start and finish rows of events, batch or stream."""
    finish = F.timestamp_add("SECOND", F.ceil("value").cast("int"), F.col("ts"))
    both = F.array(
        F.struct(F.lit("start").alias("phase"), F.col("ts").alias("at")),
        F.struct(F.lit("finish").alias("phase"), finish.alias("at")),
    )
    return events.select(
        "event_id", F.col("event_type").alias("endpoint"), F.inline(both)
    ).withColumn("row_id", F.col("event_id") * 2 + (F.col("phase") == "finish").cast("int"))


@register(
    "in_flight",
    """WITH phases AS (
  SELECT event_id * 2 AS row_id, event_type AS endpoint, ts AS moment, 1 AS d FROM events
  UNION ALL SELECT event_id * 2 + 1, event_type, ts + to_seconds(ceil(value)::INTEGER), -1 FROM events)
SELECT row_id, endpoint, CAST(sum(d) OVER (PARTITION BY endpoint ORDER BY moment, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM phases""",
)
def in_flight(spark: SparkSession, folder: str) -> DataFrame:
    delta = F.when(F.col("phase") == "start", 1).otherwise(-1)
    running = opsmetrics.in_flight(phases(spark, folder), "endpoint", "at", "row_id", delta)
    return running.select("row_id", "endpoint", "in_flight")


@register(
    "stage_durations",
    """SELECT event_type AS stage, count(*) AS runs, round(avg(ceil(value)), 6) AS mean_s, max(ceil(value)) AS max_s FROM events GROUP BY 1""",
)
def stage_durations(spark: SparkSession, folder: str) -> DataFrame:
    rows = phases(spark, folder)
    spans = rows.groupBy("event_id", F.col("endpoint").alias("stage")).agg(
        F.min("at").alias("started"), F.max("at").alias("finished")
    )
    found = opsmetrics.stage_durations(spans, ["stage"], "started", "finished")
    return found.withColumn("mean_s", F.round("mean_s", 6))
