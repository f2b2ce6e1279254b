"""Offline export, latest-row table, lookups and point-in-time features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas
from tidegauge.functions.dates import minute_timestamp
from tidegauge.operators.contracts import LOOKUP_MISSING
from tidegauge.operators.ranking import dense_index, latest_per_key, segmented_scan

START = "2024-01-01 00:00:00"
VERSIONS = ["event_timestamp", "created_timestamp"]


def with_event_times(df: DataFrame, order_by: list[Column], start: str = START) -> DataFrame:
    """Add event and creation time: start plus one minute per row in the given order."""
    indexed = dense_index(df, order_by, "_position")
    moment = minute_timestamp(F.col("_position"), start)
    return indexed.withColumns({"event_timestamp": moment, "created_timestamp": moment}).drop("_position")


def feature_export(encoded: DataFrame, entity: str = "customer_id") -> DataFrame:
    """Encoded rows in the layout of the offline store."""
    return encoded.select(
        F.col(entity).cast("long").alias("customer_id"),
        *VERSIONS,
        *[F.col(f"`{c}`").cast("double").alias(c) for c in schemas.FEATURES],
    )


def export_summary(export: DataFrame, features: Sequence[str] = schemas.FEATURES) -> DataFrame:
    """Rows, feature count and time range of an export."""
    return export.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(features)).alias("feature_count"),
        F.min("event_timestamp").alias("event_timestamp_start"),
        F.max("event_timestamp").alias("event_timestamp_end"),
    )


def latest_features(
    facts: DataFrame, keys: Sequence[str] = ("customer_id",), versions: Sequence[str] = tuple(VERSIONS)
) -> DataFrame:
    """State of the online table: the newest row per entity."""
    return latest_per_key(facts, list(keys), list(versions))


def materialize(
    online: DataFrame | None,
    facts: DataFrame,
    after: Column | None = None,
    keys: Sequence[str] = ("customer_id",),
    versions: Sequence[str] = tuple(VERSIONS),
) -> DataFrame:
    """Online table after the facts newer than ``after`` are merged in.

    Late rows never replace newer ones: the table and the facts are reduced together.
    """
    fresh = facts if after is None else facts.where(F.col(versions[0]) > after)
    newest = latest_features(fresh, keys, versions)
    if online is None:
        return newest
    return latest_features(online.unionByName(newest), keys, versions)


def lookup(
    requests: DataFrame, online: DataFrame, features: Sequence[str], key: str = "customer_id"
) -> DataFrame:
    """Latest features per request; rows whose features are all null get an error."""
    joined = requests.join(online.select(key, *[F.col(f"`{c}`") for c in features]), key, "left")
    found = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in features]).isNotNull()
    return joined.withColumns(
        {
            "status": F.when(found, "ok").otherwise("error"),
            "error": F.when(~found, F.lit(LOOKUP_MISSING)),
        }
    )


def as_of(
    labels: DataFrame,
    facts: DataFrame,
    key: str,
    label_time: str,
    fact_time: str,
    features: Sequence[str],
    ttl: str | None = None,
    created: str | None = None,
) -> DataFrame:
    """Point-in-time features: per label the newest fact not after it and within the time to live.

    Labels and facts are laid in one order of (key, time), and one scan carries the last fact of a key to the
    labels after it. No pair of rows is formed, nothing is joined, and neither a busy key nor a busy day
    ends in one task. A fact at the label's own time is visible to it; of facts with one key, time and
    creation time the one with the greatest content hash counts. A label without a key sees nothing.
    """
    sides = facts.select(
        F.col(key),
        F.col(fact_time).alias("_time"),
        F.lit(0).alias("_side"),
        (F.col(created) if created else F.lit(None).cast("timestamp")).alias("_created"),
        F.struct(F.col(fact_time).alias("_at"), *[F.col(f"`{c}`") for c in features]).alias("_fact"),
    ).unionByName(
        labels.select(
            F.col(key),
            F.col(label_time).alias("_time"),
            F.lit(1).alias("_side"),
            F.struct(*[F.col(f"`{c}`") for c in labels.columns]).alias("_label"),
        ),
        allowMissingColumns=True,
    )
    is_fact = F.col("_side") == 0
    # rows of one instant are told apart by their content, so their order does not depend on the partitioning
    scanned = segmented_scan(
        sides.withColumn("_tie", F.xxhash64("_fact", "_label")),
        [key],
        [F.col("_time"), F.col("_side"), F.col("_created"), F.col("_tie")],
        carried={"_fact": F.col("_fact")},
    )
    met = scanned.where(~is_fact)
    usable = F.col(key).isNotNull()
    if ttl is not None:
        usable = usable & (F.col("_fact._at") > F.col("_time") - F.expr(f"INTERVAL {ttl}"))
    visible = F.when(usable, F.col("_fact"))
    return met.select(
        "_label.*",
        visible.getField("_at").alias("feature_timestamp"),
        *[visible.getField(c).alias(c) for c in features],
    )
