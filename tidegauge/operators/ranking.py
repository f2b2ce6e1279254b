"""Global order without a single-task window, top fractions, latest row per key."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.session import durable


def running_totals(
    df: DataFrame,
    order_by: list[Column],
    totals: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add global running sums of whole-number columns in the given order.

    Rows are range-partitioned by the full sort key, so a value shared by many
    rows is split by the later sort columns. The sorted frame is checkpointed;
    the per-partition sums (one row per partition) give each partition its
    start, and each task streams its rows once. No task sees more than its
    range. ``order_by`` must end in a unique column for a stable order.
    """
    spark = df.sparkSession
    names = list(totals)
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prepared = df.withColumns({n: F.coalesce(c.cast("long"), F.lit(0)) for n, c in totals.items()})
    ranged = durable(
        prepared.repartitionByRange(partitions, *order_by).sortWithinPartitions(*order_by)
    ).withColumn("_range", F.spark_partition_id())

    sums = ranged.groupBy("_range").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = {
        row["_range"]: [row[n] for n in names]
        for row in sums.select(
            "_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names]
        ).collect()  # one row per partition
    }

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[int] | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            place = batch.schema.get_field_index("_range")
            if carried is None:
                carried = list(starts[batch.column(place)[0].as_py()])
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_range"}
            for k, name in enumerate(names):
                summed = columns[name].to_numpy(zero_copy_only=False).cumsum() + carried[k]
                columns[name] = pa.array(summed, type=pa.int64())
                carried[k] = int(summed[-1])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return ranged.mapInArrow(add_up, prepared.schema)


def global_rank(df: DataFrame, order_by: list[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based row number over the whole frame."""
    return running_totals(df, order_by, {name: F.lit(1)})


def top_count(n_rows: Column, fraction: float) -> Column:
    """Rows in the top fraction: ceil(n * fraction), at least one."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("top fraction must be in (0, 1]")
    return F.greatest(F.ceil(n_rows * F.lit(float(fraction))), F.lit(1))


def top_per_key(df: DataFrame, keys: list[str], order_by: list[Column], k: int) -> DataFrame:
    """The first k rows per key, with their place in ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def latest_per_key(df: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """The row with the greatest version columns per key.

    A max_by aggregate keeps one row per key and task before the shuffle, so a
    key that holds much of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*versions))
    picked = df.groupBy(*keys).agg(newest.alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def _changes(column: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal to each other."""
    whole = pa.concat_arrays([pa.nulls(1, column.type) if last is None else last, column])
    before, after = whole[:-1], whole[1:]
    same = pc.fill_null(pc.equal(before, after), False).to_numpy(zero_copy_only=False)
    return ~(same | pc.and_(before.is_null(), after.is_null()).to_numpy(zero_copy_only=False))


def segmented_scan(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    totals: Mapping[str, Column] | None = None,
    carried: Mapping[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Running values that start anew at each key, in one pass over sorted ranges.

    ``totals`` become running sums of whole numbers, ``carried`` the last value so far that is not null; both
    include the row itself. Rows are range-partitioned by key and order, so a busy key is spread over
    ranges; what the last key of a range holds there (one row per range) is handed on to the ranges after it.
    The result is a projection of the sorted rows: nothing is joined. Rows without a key are a key of their own.
    """
    totals, carried = dict(totals or {}), dict(carried or {})
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prepared = df.withColumns({**{n: F.coalesce(c.cast("long"), F.lit(0)) for n, c in totals.items()}, **carried})
    columns = [F.col(f"`{k}`") for k in keys]
    order = [*columns, *order_by]
    ranged = durable(prepared.repartitionByRange(partitions, *order).sortWithinPartitions(*order))
    ranged = ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    summed_names, carried_names, names = list(totals), list(carried), prepared.columns
    starts = _range_starts(ranged, columns, summed_names, carried_names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Array] | None = None
        sums = {n: 0 for n in summed_names}
        held: dict[str, pa.Array] = {}
        fresh = True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = {n: k for k, n in enumerate(batch.schema.names)}
            if fresh and (start := starts.get(batch.column(at["_range"])[0].as_py())) is not None:
                last, sums, held = start
            own = [batch.column(at[k]) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for k, column in enumerate(own):
                new |= _changes(column, last[k] if last is not None else None)
            new[0] |= fresh and last is None
            fresh, last = False, [c[-1:] for c in own]
            place = np.arange(batch.num_rows)
            head = np.maximum.accumulate(np.where(new, place, -1))
            out = {n: batch.column(k) for n, k in at.items() if n not in ("_range", "_at")}
            for name in summed_names:
                summed = out[name].to_numpy(zero_copy_only=False).cumsum()
                before = np.where(head > 0, summed[np.maximum(head, 1) - 1], 0)
                summed = summed - before + np.where(head < 0, sums[name], 0)
                sums[name] = int(summed[-1])
                out[name] = pa.array(summed, pa.int64())
            for name in carried_names:
                column = out[name]
                source = pa.concat_arrays([held[name].cast(column.type) if name in held else pa.nulls(1, column.type), column])
                known = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), place, -1))
                # place 0 is what was held before this batch
                pick = np.where(known >= np.maximum(head, 0), known + 1, 0)
                out[name] = source.take(pa.array(pick, mask=(pick == 0) & (head >= 0)))
                held[name] = out[name][-1:]
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return ranged.mapInArrow(scan, prepared.schema)


def _range_starts(ranged: DataFrame, keys: list[Column], totals: list[str], carried: list[str]) -> dict[int, tuple]:
    """Per range, if its first key was open before: that key, and its sums and last values so far."""
    names = [f"_k{n}" for n in range(len(keys))]
    key = F.struct(*[k.alias(n) for k, n in zip(keys, names)]) if keys else F.struct(F.lit(1).alias("_none"))
    edges = ranged.groupBy("_range").agg(F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"))
    at = F.col("_at")
    tails = (
        ranged.join(F.broadcast(edges), "_range")  # one row per range
        .where(key.eqNullSafe(F.col("_last")))
        .groupBy("_range")
        .agg(
            F.first("_first").eqNullSafe(F.first("_last")).alias("whole"),
            F.first("_first").alias("first"), F.first("_last").alias("last"),
            *[F.sum(n).alias(f"sum {n}") for n in totals],
            *[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(f"last {n}") for n in carried],
        )
        .toArrow()
        .sort_by("_range")
        .combine_chunks()
    )
    starts, open_ = {}, None
    for row in range(tails.num_rows):
        one = tails.slice(row, 1)
        cell = lambda n: one.column(n).chunk(0)
        first, last = cell("first")[0].as_py(), cell("last")
        goes_on = open_ is not None and open_[3] == first
        if goes_on:
            starts[cell("_range")[0].as_py()] = open_[:3]
        sums = {n: cell(f"sum {n}")[0].as_py() for n in totals}
        held = {n: cell(f"last {n}") for n in carried}
        if goes_on and cell("whole")[0].as_py():
            sums = {n: x + open_[1][n] for n, x in sums.items()}
            held = {n: x if x[0].is_valid else open_[2][n] for n, x in held.items()}
        open_ = ([last.field(n) for n in names], sums, held, last[0].as_py())
    return starts


def running_sum_per_key(
    df: DataFrame, keys: list[str], order_by: list[Column], value: Column, name: str
) -> DataFrame:
    """Running sum of whole numbers inside each key; neither a busy key nor a busy moment ends in one task."""
    return segmented_scan(df, keys, order_by, {name: value})


def with_key_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with one more in front of each key that holds sums over it, and how to carry these to the key's rows.

    ``_row`` is 0 for the added rows and 1 for the others; sort by it first.
    """
    heads = df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()]).withColumn("_row", F.lit(0))
    whole = df.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return whole, {n: F.col(n) for n in sums}


def quantile_within(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Exact interpolated quantile and row count ``n`` per key, for groups of any size.

    Equal values are counted first; the positions are found in one running
    count per key, so no group is gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    whole, carried = with_key_sums(counts, keys, {"n": F.sum("_count")})
    ranked = segmented_scan(whole, keys, [F.col("_row"), F.col(value)], {"_upto": F.col("_count")}, carried)
    position = F.lit(float(q)) * (F.col("n") - 1)
    low = F.floor(position)
    high = F.least(low + 1, F.col("n") - 1)

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_count")), F.col(value)))

    found = ranked.where("_row = 1").groupBy(*keys).agg(
        F.max("n").alias("n"),
        at(low).alias("_low"),
        at(high).alias("_high"),
        F.max(position - low).alias("_share"),
    )
    return found.select(
        *keys, "n", (F.col("_low") + F.col("_share") * (F.col("_high") - F.col("_low"))).alias(name)
    )


def dense_index(df: DataFrame, order_by: list[Column], name: str = "position") -> DataFrame:
    """Zero-based contiguous index in the given order."""
    ranked = global_rank(df, order_by, name)
    return ranked.withColumn(name, F.col(name) - F.lit(1))

