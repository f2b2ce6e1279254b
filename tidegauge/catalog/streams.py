"""Streams over the given tables, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.catalog.base import moment, register, table
from tidegauge.catalog.operations import BOUNDS, _REQUESTS_SQL, _SLIDES_SQL, _quantile_sql, _stamped, as_phases, as_requests
from tidegauge.catalog.drift import NUMBERS, SPLIT, _SHIPMENTS_SQL, _psi_sql
from tidegauge.catalog.jobs import _SPOILED_SQL, log_part, spoiled_log
from tidegauge.catalog.store import _LATEST_SQL
from tidegauge.functions import text as tx
from tidegauge.operators import drift, featurestore
from tidegauge.session import scratch_path
from tidegauge.streaming import logs, requests
from tidegauge.streaming.online import OnlineTable

_STAMP = "%Y-%m-%d %H:%M:%S"


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table as a file stream, be it one file or a folder of them.

    The name is a pattern, since a stream takes a plain path to be a folder; a filter on names would lose the files of a folder.
    """
    layout = table(spark, folder, name).schema
    return spark.readStream.schema(layout).parquet(f"{folder.rstrip('/')}/{{{name}}}.parquet")


def _last_batch(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key of per-batch tables."""
    return featurestore.latest_features(spark.read.parquet(path), keys, ["batch"]).drop("batch")


@register(
    "stream_error_share",
    f"""WITH {_REQUESTS_SQL}, {_SLIDES_SQL}
SELECT strftime(ws, '{_STAMP}') AS window_start, count(*) AS requests, count(*) FILTER (status_code LIKE '5%') AS errors,
       round(count(*) FILTER (status_code LIKE '5%')::DOUBLE / count(*), 6) AS error_share FROM slid GROUP BY ws""",
)
def stream_error_share(spark: SparkSession, folder: str) -> DataFrame:
    """The sliding error share in update mode; the last update of a window counts."""
    events = stream(spark, folder, "events").select(moment("ts").alias("ts"), "event_type")
    path = scratch_path(spark, "error-share")
    shares = logs.error_share(events, F.col("event_type") == "error")
    logs.run_available(shares, logs.per_batch_table(path), "update")
    found = _last_batch(spark, path, ["window_start"])
    return _stamped(found).withColumn("error_share", F.round("error_share", 6))


@register(
    "stream_error_share_by_endpoint",
    f"""WITH {_REQUESTS_SQL}, {_SLIDES_SQL}
SELECT endpoint, method, strftime(ws, '{_STAMP}') AS window_start, count(*) AS requests, count(*) FILTER (status_code LIKE '5%') AS errors,
       round(count(*) FILTER (status_code LIKE '5%')::DOUBLE / count(*), 6) AS error_share FROM slid GROUP BY endpoint, method, ws""",
)
def stream_error_share_by_endpoint(spark: SparkSession, folder: str) -> DataFrame:
    """The sliding error share with the labels of the requests."""
    path, keys = scratch_path(spark, "error-share"), ["endpoint", "method"]
    shares = logs.error_share(
        as_requests(stream(spark, folder, "events")), F.col("status_code").startswith("5"), keys=keys
    )
    logs.run_available(shares, logs.per_batch_table(path), "update")
    found = _last_batch(spark, path, [*keys, "window_start"])
    return _stamped(found).withColumn("error_share", F.round("error_share", 6))


@register(
    "stream_latency_p95",
    f"""WITH {_REQUESTS_SQL}, {_SLIDES_SQL},
counted AS (SELECT endpoint, ws, count(*) AS n, {", ".join(f"count(*) FILTER (latency_s <= {b}::DOUBLE) AS le_{i}" for i, b in enumerate(BOUNDS))} FROM slid GROUP BY endpoint, ws)
SELECT endpoint, strftime(ws, '{_STAMP}') AS window_start, n AS requests, round({_quantile_sql()}, 6) AS p95 FROM counted""",
)
def stream_latency_p95(spark: SparkSession, folder: str) -> DataFrame:
    """The sliding p95 per endpoint of a stream of requests."""
    path, keys = scratch_path(spark, "latency"), ["endpoint"]
    found = logs.latency_p95(as_requests(stream(spark, folder, "events")), BOUNDS, keys=keys)
    logs.run_available(found, logs.per_batch_table(path), "update")
    return _stamped(_last_batch(spark, path, [*keys, "window_start"])).withColumn("p95", F.round("p95", 6))


@register(
    "stream_request_rate",
    f"""WITH {_REQUESTS_SQL}
SELECT endpoint, strftime(date_trunc('minute', ts), '{_STAMP}') AS window_start, count(*) AS requests, count(*)::DOUBLE AS per_minute
FROM req GROUP BY endpoint, date_trunc('minute', ts)""",
)
def stream_request_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Requests per minute and endpoint of a stream."""
    path, keys = scratch_path(spark, "rate"), ["endpoint"]
    rates = logs.request_rate(as_requests(stream(spark, folder, "events")), keys)
    logs.run_available(rates, logs.per_batch_table(path), "update")
    return _stamped(_last_batch(spark, path, [*keys, "window_start"]))


@register(
    "stream_latest",
    f"""WITH {_LATEST_SQL} SELECT customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp, event_id AS created, event_type, value FROM latest""",
)
def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The online table kept up to date by a stream of facts."""
    incoming = stream(spark, folder, "events").select(
        F.col("user_id").alias("customer_id"), moment("ts").alias("event_timestamp"),
        F.col("event_id").alias("created"), "event_type", "value",
    )
    path, keys, versions = scratch_path(spark, "online"), ["customer_id"], ["event_timestamp", "created"]
    logs.run_available(incoming, logs.refresh_online(path, keys, versions))
    state = logs.read_online(spark, path, keys, versions)
    return state.withColumn(
        "event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


@register(
    "stream_latest_compacted",
    f"""WITH {_LATEST_SQL} SELECT customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp, event_id AS created, event_type, value, 1 AS n_folders FROM latest""",
)
def stream_latest_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The online table fed by three micro-batches, compacted after the second and at the end, read by its manifest."""
    facts = table(spark, folder, "events").select(
        F.col("user_id").alias("customer_id"), moment("ts").alias("event_timestamp"),
        F.col("event_id").alias("created"), "event_type", "value",
    )
    arrivals, state = scratch_path(spark, "arrivals"), scratch_path(spark, "online-checkpoint")
    online = OnlineTable(spark, scratch_path(spark, "online"), ["customer_id"], ["event_timestamp", "created"])
    for part in range(3):
        facts.where(F.pmod(F.col("created"), F.lit(3)) == part).write.mode("append").parquet(arrivals)
        incoming = spark.readStream.schema(facts.schema).parquet(arrivals)
        logs.run_available(incoming, online.handler("facts"), checkpoint=state)
        if part:
            online.compact()
    return online.read().withColumns(
        {
            "event_timestamp": F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            "n_folders": F.lit(len(online.manifest()["folders"])),
        }
    )


@register(
    "stream_drift",
    f"""WITH {_SHIPMENTS_SQL}, {_psi_sql('ship', NUMBERS, 'is_ref')}
SELECT CASE WHEN max(psi) >= 0.2 THEN 'critical' WHEN max(psi) >= 0.1 THEN 'warning' ELSE 'ok' END AS status,
       round(max(psi), 6) AS max_feature_psi, (SELECT count(*) FROM ship WHERE NOT is_ref) AS current_row_count,
       TRUE AS decision_eligible FROM psi""",
)
def stream_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments after the date as a stream against the edges of those before it."""
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    reference = table(spark, folder, "lineitem").where(F.col("l_shipdate") < cut)
    edges = drift.fit_edges(reference, None, NUMBERS)
    current = (
        stream(spark, folder, "lineitem")
        .where(F.col("l_shipdate") >= cut)
        .withColumn("l_extendedprice", F.col("l_extendedprice") * 1.25)
    )
    path = scratch_path(spark, "decisions")
    counts = logs.bin_counts(current, edges, SPLIT)
    logs.run_available(counts, logs.drift_decisions(drift.count_values(reference, edges, []), path), "complete")
    decisions = spark.read.parquet(path)
    # one decision row per batch
    newest = decisions.orderBy(F.col("batch_id").desc()).limit(1)
    return newest.select(
        "status", F.round("max_feature_psi", 6).alias("max_feature_psi"), "current_row_count", "decision_eligible"
    )


SHIPMENT_TEXTS = ["l_returnflag", "l_linestatus"]


def _odd_texts() -> dict[str, Column]:
    """Later shipments know a flag of their own; a fifth of all has no status, and one status is named '0'."""
    later = F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz")
    named = F.when(F.col("l_linestatus") == "F", F.lit("0")).otherwise(F.col("l_linestatus"))
    return {
        "l_returnflag": F.when(later & (F.col("l_orderkey") % 3 == 0), F.lit("X")).otherwise(F.col("l_returnflag")),
        "l_linestatus": F.when(F.col("l_orderkey") % 5 != 0, named),
    }


_SHIPMENTS_MIXED_SQL = f"""ship AS (
  SELECT l_quantity, l_discount, l_tax, is_ref, CASE WHEN is_ref THEN l_extendedprice ELSE l_extendedprice * 1.25::DOUBLE END AS l_extendedprice,
         CASE WHEN NOT is_ref AND l_orderkey % 3 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_linestatus = 'F' THEN '0' ELSE l_linestatus END AS l_linestatus
  FROM (SELECT *, l_shipdate < TIMESTAMP '{SPLIT}' AS is_ref FROM lineitem))"""


def _category_psi_sql(features: list[str]) -> str:
    """The WITH parts that give ``tpsi``: indices of text features of ``ship``, by category."""
    values = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, is_ref, coalesce(CAST({f} AS VARCHAR), '__missing__') AS bin FROM ship" for f in features
    )
    return f"""
tvals AS ({values}),
tgrid AS (SELECT feature, bin, count(*) FILTER (is_ref) AS rn, count(*) FILTER (NOT is_ref) AS cn FROM tvals GROUP BY ALL),
tshares AS (SELECT feature, greatest(1e-6::DOUBLE, rn::DOUBLE / greatest(1, sum(rn) OVER (PARTITION BY feature))) AS rs,
                   greatest(1e-6::DOUBLE, cn::DOUBLE / greatest(1, sum(cn) OVER (PARTITION BY feature))) AS cs FROM tgrid),
tpsi AS (SELECT feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM tshares GROUP BY feature)"""


@register(
    "stream_drift_mixed",
    f"""WITH {_SHIPMENTS_MIXED_SQL}, {_psi_sql('ship', NUMBERS, 'is_ref')}, {_category_psi_sql(SHIPMENT_TEXTS)}
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'ok' END AS status,
       (SELECT count(*) FROM ship WHERE NOT is_ref) AS current_row_count
FROM (SELECT feature, psi FROM psi UNION ALL SELECT feature, psi FROM tpsi)""",
)
def stream_drift_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and texts of later shipments as a stream against those before; a third of the later flags are new."""
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    items = table(spark, folder, "lineitem").withColumns(_odd_texts())
    reference = items.where(F.col("l_shipdate") < cut)
    edges = drift.fit_edges(reference, None, NUMBERS)
    current = stream(spark, folder, "lineitem").where(F.col("l_shipdate") >= cut).withColumns(
        {"l_extendedprice": F.col("l_extendedprice") * 1.25, **_odd_texts()}
    )
    path = scratch_path(spark, "decisions")
    counts = logs.bin_counts(current, edges, SPLIT, SHIPMENT_TEXTS)
    reference_counts = drift.count_values(reference, edges, SHIPMENT_TEXTS)
    logs.run_available(counts, logs.drift_decisions(reference_counts, path), "complete")
    newest = spark.read.parquet(path).orderBy(F.col("batch_id").desc()).limit(1)  # one decision row per batch
    return newest.select(F.explode("feature_psi").alias("feature", "psi"), "current_row_count").select(
        "feature", F.round("psi", 6).alias("psi"), drift.status_band(F.col("psi")).alias("status"), "current_row_count"
    )


@register(
    "stream_drift_rows",
    f"""SELECT count(*) AS current_row_count, count(*) >= 30 AS decision_eligible FROM lineitem
WHERE l_shipdate >= TIMESTAMP '{SPLIT}'""",
)
def stream_drift_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The row count behind a streamed decision when each feature misses half of its values."""
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    columns = ["l_quantity", "l_discount"]
    reference = table(spark, folder, "lineitem").where(F.col("l_shipdate") < cut)
    edges = drift.fit_edges(reference, None, columns)
    odd = F.col("l_linenumber") % 2 == 1
    current = stream(spark, folder, "lineitem").where(F.col("l_shipdate") >= cut).withColumns(
        {"l_quantity": F.when(odd, F.col("l_quantity")), "l_discount": F.when(~odd, F.col("l_discount"))}
    )
    path = scratch_path(spark, "decisions")
    counts = logs.bin_counts(current, edges, SPLIT)
    logs.run_available(counts, logs.drift_decisions(drift.count_values(reference, edges, []), path), "complete")
    newest = spark.read.parquet(path).orderBy(F.col("batch_id").desc()).limit(1)  # one decision row per batch
    return newest.select("current_row_count", "decision_eligible")


@register(
    "stream_guardrail",
    r"""WITH a AS (SELECT conv_id, turn, role, text, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL_REDACTED]', 'g') AS t1 FROM conversations),
b AS (SELECT *, regexp_replace(regexp_replace(t1, '\b(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}-?\d{4}\b', '[PHONE_REDACTED]', 'g'), '\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b', '[CPF_REDACTED]', 'g') AS t3 FROM a)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Input bloqueado: padrão suspeito detectado.' ELSE 'OK' END AS verdict,
       md5(CASE WHEN role = 'system' THEN 'system: ' ELSE '' END || t3) AS digest FROM b""",
)
def stream_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    opening = F.when(F.col("role") == "system", "system: ").otherwise("")
    incoming = stream(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat(opening, F.col("text")).alias("text")
    )
    path = scratch_path(spark, "messages")
    guarded = logs.guarded_messages(incoming, limit=10 * tx.MAX_INPUT_CHARS)
    logs.run_available(guarded, logs.per_batch_table(path))
    return spark.read.parquet(path).select(
        "conv_id", "turn", "verdict", F.md5(F.col("redacted").cast("binary")).alias("digest")
    )


@register(
    "stream_in_flight",
    """WITH phases AS (SELECT event_type AS endpoint, ts AS moment, 1 AS d FROM events
  UNION ALL SELECT event_type, ts + to_seconds(ceil(value)::INTEGER), -1 FROM events)
SELECT endpoint, CAST(sum(d) AS BIGINT) AS in_flight FROM phases WHERE moment <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY endpoint""",
)
def stream_in_flight(spark: SparkSession, folder: str) -> DataFrame:
    """Requests under way per endpoint at a given time."""
    events = stream(spark, folder, "events").withColumn("ts", moment("ts"))
    finish = F.timestamp_add("SECOND", F.ceil("value").cast("int"), F.col("ts"))
    both = F.array(
        F.struct(F.lit(1).alias("delta"), F.col("ts").alias("at")),
        F.struct(F.lit(-1).alias("delta"), finish.alias("at")),
    )
    phases = events.select(F.col("event_type").alias("endpoint"), F.inline(both)).where(
        F.col("at") <= F.lit("2024-01-20 12:00:00").cast("timestamp")
    )
    path = scratch_path(spark, "gauge")
    logs.run_available(logs.in_flight(phases, "endpoint", F.col("delta")), logs.per_batch_table(path), "update")
    return _last_batch(spark, path, ["endpoint"])


@register(
    "stream_request_lifetimes",
    """WITH req AS (SELECT event_id, event_type AS endpoint, epoch_ms(ts) AS s, epoch_ms(ts + to_seconds(ceil(value)::INTEGER)) AS f, event_id % 7 = 0 AS lost FROM events),
line AS (SELECT max(CASE WHEN lost THEN s ELSE f END) - 600000 AS w FROM req),
judged AS (SELECT endpoint, CASE WHEN lost AND s + 60000 > w THEN 'open' WHEN lost OR f - s > 60000 THEN 'expired' ELSE 'finished' END AS outcome FROM req, line)
SELECT endpoint, count(*) AS started, count(*) FILTER (outcome = 'finished') AS finished, count(*) FILTER (outcome = 'expired') AS expired,
       count(*) FILTER (outcome = 'open') AS in_flight FROM judged GROUP BY 1""",
)
def stream_request_lifetimes(spark: SparkSession, folder: str) -> DataFrame:
    """Requests under way per endpoint after all events; a seventh never finishes and expires after a minute."""
    events = stream(spark, folder, "events").withColumn("ts", moment("ts"))
    seen = as_phases(events).where((F.col("event_id") % 7 != 0) | (F.col("phase") == "start"))
    path = scratch_path(spark, "in-flight")
    with requests.use_rocks(spark):
        changes = requests.gauge_changes(seen, "event_id", "endpoint", "phase", "at", 60)
        logs.run_available(changes, logs.per_batch_table(path))
    return requests.under_way(spark.read.parquet(path), ["endpoint"])


@register(
    "stream_line_faults",
    f"""SELECT part, line, fault FROM ({_SPOILED_SQL}) WHERE fault IS NOT NULL
UNION ALL SELECT part, count(*), 'accepted' FROM ({_SPOILED_SQL}) WHERE fault IS NULL AND event_type <> 'purchase' GROUP BY part""",
)
def stream_line_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The spoiled log as a stream that follows its files: bad lines by number, and accepted lines of each file."""
    path, out = spoiled_log(spark, folder), scratch_path(spark, "line-faults")
    handler = logs.number_faults(out, logs.per_batch_table(f"{out}/accepted"))
    logs.run_available(logs.tailed_log(spark, path), handler)
    faults = spark.read.parquet(f"{out}/faults").select(log_part().alias("part"), "line", "fault")
    accepted = spark.read.parquet(f"{out}/accepted").groupBy(log_part().alias("part")).agg(
        F.count(F.lit(1)).alias("line"), F.lit("accepted").alias("fault")
    )
    return faults.unionByName(accepted)
