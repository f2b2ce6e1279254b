"""Streams over the inference log, request events and messages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge import schemas
from tidegauge.functions import text as tx
from tidegauge.operators import drift, featurestore, opsmetrics
from tidegauge.session import scratch_path
from tidegauge.sources import lines

BatchHandler = Callable[[DataFrame, int], None]


def run_available(
    stream: DataFrame, handler: BatchHandler, mode: str = "append", checkpoint: str | None = None
) -> StreamingQuery:
    """Process all input there is, batch by batch, and stop."""
    location = checkpoint or scratch_path(stream.sparkSession, "stream-state")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", location)
        .foreachBatch(handler)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def per_batch_table(path: str) -> BatchHandler:
    """Handler that writes each batch to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


# --- inference log ----------------------------------------------------------


def inference_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream, with ``event_time`` and a ``fault`` for records off contract."""
    layout = T.StructType([*schemas.INFERENCE_LOG.fields, T.StructField("_bad_line", T.StringType())])
    rows = (
        spark.readStream.schema(layout)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad_line")
        .json(path)
    )
    missing = F.lit(False)
    for name in schemas.FEATURES:
        missing = missing | F.col(f"`{name}`").isNull()
    fault = (
        F.when(F.col("_bad_line").isNotNull(), "invalid_json")
        .when(~F.col("monitoring_contract").eqNullSafe(schemas.MONITORING_CONTRACT), "other_contract")
        .when(missing, "missing_feature")
    )
    return rows.withColumns({"event_time": F.col("timestamp").try_cast("timestamp"), "fault": fault})


def split_faults(quarantine: str, accept: BatchHandler) -> BatchHandler:
    """Handler that sets faulty records aside and passes the others on."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        faulty = batch.where(F.col("fault").isNotNull())
        faulty.write.mode("overwrite").json(f"{quarantine}/batch={batch_id}")
        accept(batch.where(F.col("fault").isNull()).drop("fault", "_bad_line"), batch_id)

    return handle


def tailed_log(spark: SparkSession, path: str, range_bytes: int = lines.RANGE_BYTES) -> DataFrame:
    """Lines of a growing log with a ``fault`` for those that are no JSON object; blank lines are kept."""
    text = tx.trim_space(F.col("value"))
    state = tx.json_status(text)
    fault = F.when(text == "", None).when(state == "json_invalid", "invalid_json").when(
        state == "json_non_dict", "not_object"
    )
    return lines.tail(spark, path, range_bytes).withColumns({"blank": text == "", "fault": fault})


def number_faults(path: str, accept: BatchHandler) -> BatchHandler:
    """Handler that sets faulty lines of :func:`tailed_log` aside with their line numbers, and passes the others on.

    Below ``path``, ``lines`` keeps one row per batch and byte range, from which later batches count on,
    and ``faults`` the lines set aside. A repeated batch replaces what it wrote.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # read three times; the files may grow meanwhile, the ranges of a batch do not
        held = batch.persist()
        try:
            counts = held.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"))
            counts.write.mode("overwrite").parquet(f"{path}/lines/batch={batch_id}")
            known = spark.read.schema("file string, range long, n long, batch long").parquet(f"{path}/lines")
            starts = lines.first_lines(known.where(F.col("batch") <= batch_id))
            faulty = held.where(F.col("fault").isNotNull()).join(starts, ["file", "range"])
            faulty.select("file", (F.col("before") + F.col("place") + 1).alias("line"), "at", "fault", "value").write.mode(
                "overwrite"
            ).parquet(f"{path}/faults/batch={batch_id}")
            accept(held.where(F.col("fault").isNull() & ~F.col("blank")).select("file", "at", "value"), batch_id)
        finally:
            held.unpersist()

    return handle


# --- operations -------------------------------------------------------------


def error_share(
    events: DataFrame, failed: Column, time: str = "ts", delay: str = "10 minutes",
    length: str = "5 minutes", slide: str = "1 minute", keys: Sequence[str] = (),
) -> DataFrame:
    """Sliding share of failures, per key if keys are given; rows later than the delay are dropped."""
    return opsmetrics.error_share(events.withWatermark(time, delay), failed, keys, time, length, slide)


def latency_p95(
    events: DataFrame, bounds: list[float], time: str = "ts", latency: str = "latency_s", delay: str = "10 minutes",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Sliding bucket-interpolated p95, per key if keys are given."""
    return opsmetrics.latency_p95(events.withWatermark(time, delay), bounds, keys, time, latency)


def request_rate(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Requests per minute."""
    return opsmetrics.request_rate(events.withWatermark(time, delay), keys, time)


def in_flight(events: DataFrame, key: str, delta: Column) -> DataFrame:
    """Requests under way per endpoint; the state is one number per endpoint."""
    return events.groupBy(key).agg(F.sum(delta).alias("in_flight"))


# --- messages ---------------------------------------------------------------


def guarded_messages(messages: DataFrame, text: str = "text", limit: int = tx.MAX_INPUT_CHARS) -> DataFrame:
    """Verdict and redacted text per message, batch or stream."""
    return messages.withColumns(
        {"verdict": tx.guardrail_message(F.col(text), limit), "redacted": tx.redact_pii(F.col(text))}
    )


# --- online table -----------------------------------------------------------


def refresh_online(path: str, keys: list[str], versions: list[str]) -> BatchHandler:
    """Handler that adds each batch's newest row per key to a log-structured table.

    What a batch writes grows with the batch, not with the table; readers reduce,
    and :func:`compact_online` shortens the log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = featurestore.latest_features(batch, keys, versions)
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_online(spark: SparkSession, path: str, keys: list[str], versions: list[str]) -> DataFrame:
    """State of the online table: newest row per key over all batches."""
    return featurestore.latest_features(spark.read.parquet(path).drop("batch"), keys, versions)


def compact_online(spark: SparkSession, path: str, target: str, keys: list[str], versions: list[str]) -> None:
    """Write the reduced state as the first batch of a new table."""
    read_online(spark, path, keys, versions).write.mode("overwrite").parquet(f"{target}/batch=-1")


# --- drift ------------------------------------------------------------------


ALL_ROWS = "__rows__"


def bin_counts(
    current: DataFrame, edges: drift.Edges, reference_version: str, categorical: Sequence[str] = ()
) -> DataFrame:
    """Running counts of a stream per (reference version, feature, bin), against fixed edges.

    The bins of ``categorical`` features are their categories, kept in the same state. All rows
    are counted too, nulls or not, as the feature ``__rows__``.
    """
    stamped = current.withColumns({"reference_version": F.lit(reference_version), ALL_ROWS: F.lit(0.0)})
    return drift.count_values(stamped, {**edges, ALL_ROWS: []}, list(categorical), ["reference_version"])


def drift_decisions(
    reference_counts: DataFrame, path: str, minimum: int = drift.MINIMUM_ROWS
) -> BatchHandler:
    """Handler for complete-mode counts: one decision row per batch, withheld below the minimum.

    ``reference_counts`` come from :func:`drift.count_values`.
    """

    def decide(counts: DataFrame, batch_id: int) -> None:
        of_all = (F.col("kind") == "number") & (F.col("feature") == ALL_ROWS)
        # the running counts are read three times; their state is merged once
        current = counts.drop("reference_version").persist()
        try:
            psi = drift.psi_from_values(reference_counts, current.where(~of_all))
            rows = current.where(of_all).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("current_row_count"))
            decision = drift.decide(psi).withColumn("_one", F.lit(1)).join(
                rows.withColumn("_one", F.lit(1)), "_one"
            ).drop("_one")
            checked = drift.apply_minimum_sample(decision, F.col("current_row_count"), minimum)
            checked.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
                f"{path}/batch={batch_id}"
            )
        finally:
            current.unpersist()

    return decide
