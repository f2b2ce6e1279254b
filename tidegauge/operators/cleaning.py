"""Duplicate and missing-row removal, splits, class rates and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.hashing import row_fingerprint, uniform
from tidegauge.operators.ranking import segmented_scan
from tidegauge.session import durable


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicate removal."""
    return df.dropDuplicates()


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without null or NaN."""
    return df.na.drop("any")


def clean(df: DataFrame) -> DataFrame:
    """Duplicates, then rows with a missing value, removed."""
    return drop_missing(drop_duplicates(df))


def clean_report(df: DataFrame) -> DataFrame:
    """Rows in, duplicates removed, missing removed, rows out: one pass after one grouping."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    complete = F.lit(True)
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        complete = complete & value.isNotNull()
        if field.dataType.typeName() in ("double", "float"):
            complete = complete & ~F.isnan(value)
    kept = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows_in, distinct = F.coalesce(F.sum("_copies"), F.lit(0)), F.count(F.lit(1))
    rows_out = F.count_if(complete)
    return kept.agg(
        rows_in.alias("rows_in"),
        (rows_in - distinct).alias("duplicates_removed"),
        (distinct - rows_out).alias("missing_removed"),
        rows_out.alias("rows_out"),
    )


# --- split ------------------------------------------------------------------

_SPLIT_BINS = 1 << 16


def split_cuts(df: DataFrame, target: str, row_id: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Per class ``(y, cut_u, cut_id)``: the last (hash, id) pair that still belongs to the test part.

    The test part of a class is its first ceil(fraction * n) rows by hash. A
    histogram of the hash finds the bin that holds the last of them. Only the
    rows of these bins are ranked, in one global order over all classes, so
    neither the number of classes nor the size of a bin is bounded.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    draw = uniform(F.col(row_id), seed, "split")
    rows = df.select(
        F.col(target).alias("y"), F.col(row_id).alias("id"), draw.alias("u")
    ).withColumn("bin", F.floor(F.col("u") * _SPLIT_BINS).cast("int"))
    counts = rows.groupBy("y", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_class = Window.partitionBy("y")  # at most one row per bin
    upto = F.sum("n").over(per_class.orderBy("bin"))
    wanted = F.ceil(F.sum("n").over(per_class) * F.lit(float(fraction)))
    placed = counts.select("y", "bin", "n", upto.alias("upto"), wanted.alias("wanted"))
    cut = durable(
        placed.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select(F.col("y").alias("cy"), F.col("bin").alias("cbin"),
                (F.col("wanted") - (F.col("upto") - F.col("n"))).alias("need"))
    )
    near = rows.join(cut, F.col("y").eqNullSafe(F.col("cy")) & (F.col("bin") == F.col("cbin")))
    ranked = segmented_scan(
        near.select("y", "u", "id", "need"), ["y"], [F.col("u"), F.col("id")], {"place": F.lit(1)}
    )
    return ranked.where(F.col("place") == F.col("need")).select("y", F.col("u").alias("cut_u"), F.col("id").alias("cut_id"))


# Classes whose cuts go to all tasks, and the groups that a class is dealt to when there are more.
_SENT_CLASSES = 500_000
_SALTS = 64


def stratified_split(
    df: DataFrame, target: str, row_id: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` ('train' or 'test'), the same for any partitioning of the rows.

    The cuts, one short row per class, are stored and counted. They are sent to all tasks while there are few; more of
    them meet the rows by class and a salt of the row, so that a busy class is spread.
    """
    cuts = durable(
        split_cuts(df, target, row_id, fraction, seed).select(
            F.col("y").alias("_cut_y"), F.col("cut_u").alias("_cut_u"), F.col("cut_id").alias("_cut_id")
        )
    )
    draw = uniform(F.col(row_id), seed, "split")
    before = (draw < F.col("_cut_u")) | ((draw == F.col("_cut_u")) & (F.col(row_id) <= F.col("_cut_id")))
    same = F.col(target).eqNullSafe(F.col("_cut_y"))
    if cuts.count() <= _SENT_CLASSES:
        joined = df.join(F.broadcast(cuts), same, "left")
    else:
        spread = cuts.withColumn("_cut_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(_SALTS)).cast("int"))
        joined = salted.join(spread, same & (F.col("_salt") == F.col("_cut_salt")), "left").drop("_salt", "_cut_salt")
    split = F.when(F.coalesce(before, F.lit(False)), F.lit("test")).otherwise(F.lit("train"))
    return joined.withColumn("split", split).drop("_cut_y", "_cut_u", "_cut_id")


def class_rates(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and positive rate of a 0/1 target."""
    positives = F.count_if(F.col(target) == 1)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        positives.alias("n_positive"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
    )


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """Negatives over positives, at least one positive assumed."""
    negatives, positives = F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)
    return df.agg(
        negatives.alias("n_negative"),
        positives.alias("n_positive"),
        (negatives / F.greatest(positives, F.lit(1))).alias("neg_pos_ratio"),
    )


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free hash of the contents."""
    names = columns or df.columns
    mark = row_fingerprint(*[F.col(f"`{c}`") for c in names])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(mark).alias("xor_hash"),
        F.sum(mark.cast("decimal(38,0)") % F.lit(1_000_003)).cast("long").alias("sum_hash"),
    )


def generation_metadata(before: DataFrame, after: DataFrame, new_columns: Sequence[str]) -> DataFrame:
    """Rows and columns before and after an enrichment, with bounds of the new columns."""
    added = [c for c in after.columns if c not in before.columns]
    bounds = [
        bound
        for c in new_columns
        for bound in (F.min(f"`{c}`").alias(f"{c}_min"), F.max(f"`{c}`").alias(f"{c}_max"))
    ]
    return after.agg(F.count(F.lit(1)).alias("rows_after"), *bounds).select(
        F.lit(before.count()).alias("rows_before"),
        "rows_after",
        F.lit(len(before.columns)).alias("columns_before"),
        F.lit(len(after.columns)).alias("columns_after"),
        F.lit(",".join(added)).alias("added_columns"),
        *[F.col(f"`{c}{end}`") for c in new_columns for end in ("_min", "_max")],
    )
