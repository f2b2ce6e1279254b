"""Feature store queries over events, customers and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.catalog.base import moment, register, table
from tidegauge.operators import featurestore


def _text(column: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(column, pattern)


_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as facts about users; the event id stands for the creation order."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("customer_id"),
        moment("ts").alias("event_timestamp"),
        F.col("event_id").alias("created"),
        "event_type",
        "value",
    )


@register(
    "event_timestamps",
    """SELECT c_custkey, strftime(TIMESTAMP '2024-01-01' + to_minutes(row_number() OVER (ORDER BY c_custkey) - 1), '%Y-%m-%d %H:%M:%S') AS event_timestamp
FROM customer""",
)
def event_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    timed = featurestore.with_event_times(
        table(spark, folder, "customer").select("c_custkey"), [F.col("c_custkey")]
    )
    return timed.select("c_custkey", _text("event_timestamp").alias("event_timestamp"))


@register(
    "export_summary",
    """SELECT count(*) AS row_count, 15 AS feature_count, '2024-01-01 00:00:00' AS event_timestamp_start,
       strftime(TIMESTAMP '2024-01-01' + to_minutes(count(*) - 1), '%Y-%m-%d %H:%M:%S') AS event_timestamp_end FROM customer""",
)
def export_summary(spark: SparkSession, folder: str) -> DataFrame:
    timed = featurestore.with_event_times(
        table(spark, folder, "customer").select("c_custkey"), [F.col("c_custkey")]
    )
    return featurestore.export_summary(timed).select(
        "row_count", "feature_count",
        _text("event_timestamp_start").alias("event_timestamp_start"),
        _text("event_timestamp_end").alias("event_timestamp_end"),
    )


_LATEST_SQL = """latest AS (
  SELECT user_id AS customer_id, ts, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@register(
    "latest_per_entity",
    f"""WITH {_LATEST_SQL} SELECT customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp, event_id AS created, event_type, value FROM latest""",
)
def latest_per_entity(spark: SparkSession, folder: str) -> DataFrame:
    newest = featurestore.latest_features(
        facts(spark, folder), versions=["event_timestamp", "created"]
    )
    return newest.withColumn("event_timestamp", _text("event_timestamp", _MICROS))


@register(
    "incremental_materialize",
    f"""WITH {_LATEST_SQL} SELECT customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp, event_id AS created, event_type, value FROM latest""",
)
def incremental_materialize(spark: SparkSession, folder: str) -> DataFrame:
    """Half a month loaded, then the rest merged in: the same state as one full load."""
    every = facts(spark, folder)
    versions = ["event_timestamp", "created"]
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    first = featurestore.materialize(None, every.where(F.col("event_timestamp") <= cut), versions=versions)
    merged = featurestore.materialize(first, every, after=cut, versions=versions)
    return merged.withColumn("event_timestamp", _text("event_timestamp", _MICROS))


@register(
    "online_lookup",
    f"""WITH {_LATEST_SQL},
state AS (SELECT customer_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM latest)
SELECT o_orderkey AS request_id, o_custkey AS customer_id, event_type, value,
       CASE WHEN event_type IS NULL AND value IS NULL THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN event_type IS NULL AND value IS NULL THEN 'Cliente não encontrado na Feature Store.' END AS error
FROM orders LEFT JOIN state ON o_custkey = customer_id""",
)
def online_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each order looks up its customer; users whose last event failed have no features."""
    newest = featurestore.latest_features(
        facts(spark, folder), versions=["event_timestamp", "created"]
    )
    failed = F.col("event_type") == "error"
    online = newest.select(
        "customer_id",
        F.when(~failed, F.col("event_type")).alias("event_type"),
        F.when(~failed, F.col("value")).alias("value"),
    )
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("customer_id")
    )
    return featurestore.lookup(requests, online, ["event_type", "value"]).select(
        "request_id", "customer_id", "event_type", "value", "status", "error"
    )


@register(
    "asof_features",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, ts AS fts, value FROM events WHERE event_type IN ('view', 'click'))
SELECT event_id, l.user_id, CASE WHEN fts > ts - INTERVAL 12 HOUR THEN strftime(fts, '%Y-%m-%d %H:%M:%S.%f') END AS feature_timestamp,
       CASE WHEN fts > ts - INTERVAL 12 HOUR THEN value END AS value
FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.ts >= f.fts""",
)
def asof_features(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("ts", moment("ts"))
    labels = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = events.where(F.col("event_type").isin("view", "click")).select(
        "user_id", F.col("ts").alias("fts"), "value"
    )
    joined = featurestore.as_of(labels, views, "user_id", "ts", "fts", ["value"], ttl="12 HOURS")
    return joined.select(
        "event_id", "user_id", _text("feature_timestamp", _MICROS).alias("feature_timestamp"), "value"
    )


@register(
    "asof_features_ties",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, date_trunc('day', ts) AS fts, max(event_id) AS last_view FROM events
      WHERE event_type IN ('view', 'click') GROUP BY ALL)
SELECT event_id, l.user_id, strftime(fts, '%Y-%m-%d %H:%M:%S.%f') AS feature_timestamp, last_view
FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.ts >= f.fts""",
)
def asof_features_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of one day at one instant: the one created last counts."""
    events = table(spark, folder, "events").withColumn("ts", moment("ts"))
    labels = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = events.where(F.col("event_type").isin("view", "click")).select(
        "user_id", F.date_trunc("day", "ts").alias("fts"), F.col("event_id").alias("last_view"),
        F.timestamp_seconds("event_id").alias("made"),
    )
    joined = featurestore.as_of(labels, views, "user_id", "ts", "fts", ["last_view"], created="made")
    return joined.select(
        "event_id", "user_id", _text("feature_timestamp", _MICROS).alias("feature_timestamp"), "last_view"
    )
