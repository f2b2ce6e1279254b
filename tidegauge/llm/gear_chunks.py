"""Substring dedup by content-defined chunks: boundaries from a gear rolling hash, digests of chunk runs.

A chunk ends where the gear hash of the last 10 bytes is small, so boundaries depend on nearby bytes
only and come back in step soon after an insertion or at the head of a passage. The unit that is looked up is the digest of
``RUN`` neighbouring chunks, for every chunk. Of equal units the first (by document id, then place)
stays; bytes under the others are removed where they form a stretch of at least ``LEAST`` bytes.
Chunk ends that would split a UTF-8 character do not count.

Digests move once. Within a batch only the first of equal units is sent, so a passage that a
third of all documents hold reaches its task once per batch. Texts move once, to meet what is
to be removed from them.

Defined results: a null or empty text has nothing to remove; rows with equal id and text are one
document and get equal results; documents without an id come last; texts of any length are
chunked whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import documents_of, fresh, mix, pair, quoted, slices, text_bytes

# Mean bytes in a chunk, chunks in a unit, and the shortest stretch that is removed.
MEAN_CHUNK = 16
RUN = 4
LEAST = 128
# Gear values fill the top bits of a word only, so that a byte is shifted out after as many steps.
_REACH = 10
_GEAR = (
    mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _REACH) << np.uint64(32 - _REACH)
).astype(np.uint32)
_SMALL = np.uint32(2**32 // MEAN_CHUNK)

UNITS = "key long, doc_id long, dk long, at int, known boolean"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, text string"


def gear_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all chunks of the joined texts, and the end of the last one."""
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    at = np.arange(n) + _REACH * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    spread = np.zeros(n + _REACH * (len(sizes) + 1), np.uint32)
    spread[at] = _GEAR[data]
    step = 1
    while step < _REACH:
        spread[step:] = spread[step:] + (spread[:-step] << np.uint32(step))
        step *= 2
    ends = spread[at] < _SMALL
    starts = np.zeros(n, bool)
    starts[1:] = ends[:-1]
    starts &= (data & 0xC0) != 0x80
    starts[offsets[:-1][sizes > 0]] = True
    return np.append(np.flatnonzero(starts), n)


def chunk_digests(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every chunk: the sum of its bytes' values times powers, mixed with its length."""
    if len(data) == 0:
        return np.zeros(0, np.uint64)
    starts = cuts[:-1]
    widths = np.diff(cuts)
    place = np.arange(len(data)) - np.repeat(starts, widths)
    longest = int(widths.max())
    powers = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
    values = mix(np.arange(1, 257, dtype=np.uint64))[data] * powers[place]
    return pair(np.add.reduceat(values, starts), widths.astype(np.uint64))


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each run of chunks, the text it is in, the first chunk's number there, and all cuts.

    A text of fewer chunks than a run is one unit.
    """
    cuts = gear_cuts(data, offsets)
    digests = chunk_digests(data, cuts)
    first = np.searchsorted(cuts[:-1], offsets)
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(1, counts - RUN + 1), 0)
    owner = np.repeat(np.arange(len(counts)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = first[:-1][owner] + number
    last = first[1:][owner]
    padded = np.append(digests, np.zeros(RUN, np.uint64))
    key = padded[at]
    for k in range(1, RUN):
        key = pair(key, np.where(at + k < last, padded[at + k], np.uint64(0)))
    return key, owner, number, cuts


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of every text; of equal ones in a batch all but the first are known to be repeats."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column(2))
            key, owner, number, _ = units(data, offsets)
            if not len(key):
                continue
            ids = part.column(0)
            order_of = np.empty(part.num_rows, np.int64)
            order = pc.sort_indices(
                pa.table({"i": ids, "k": part.column(1)}), sort_keys=[("i", "ascending"), ("k", "ascending")]
            )
            order_of[order.to_numpy()] = np.arange(part.num_rows)
            # rows with equal id and text count as one
            dks = part.column(1).to_numpy()
            _, same = np.unique(dks, return_inverse=True)
            leader = np.full(same.max() + 1, part.num_rows, np.int64)
            np.minimum.at(leader, same, order_of)
            rank = leader[same][owner]
            by = np.lexsort((number, rank, key))
            twice = np.zeros(len(key), bool)
            equal = key[by][1:] == key[by][:-1]
            twin = equal & (rank[by][1:] == rank[by][:-1]) & (number[by][1:] == number[by][:-1])
            twice[by[1:]] = equal
            drop = np.zeros(len(key), bool)
            drop[by[1:]] = twin
            keep = np.flatnonzero(~drop)
            key, owner, number, twice = key[keep], owner[keep], number[keep], twice[keep]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(twice, dks[owner], key.view(np.int64))), ids.take(rows), part.column(1).take(rows),
                    pa.array(number.astype(np.int32)), pa.array(twice),
                ],
                names=["key", "doc_id", "dk", "at", "known"],
            )


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and document: those known, and those that follow one with their key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, dk, at, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        fresh_rows = np.flatnonzero(~known)
        again = known.copy()
        if len(fresh_rows):
            own = key[fresh_rows]
            same = np.empty(len(own), bool)
            same[0] = last is not None and last[0] == own[0] and (last[1], last[2]) != (dk[fresh_rows[0]], at[fresh_rows[0]])
            same[1:] = (own[1:] == own[:-1]) & (
                (dk[fresh_rows][1:] != dk[fresh_rows][:-1]) | (at[fresh_rows][1:] != at[fresh_rows][:-1])
            )
            # a row equal to the group's first one is that unit again, sent by another batch
            again[fresh_rows] = same
            end = fresh_rows[-1]
            last = (key[end], dk[end], at[end])
        yield pa.RecordBatch.from_arrays([pa.array(dk[again]), pa.array(at[again])], names=["dk", "at"])


def removed_stretches(cuts: np.ndarray, repeated: np.ndarray) -> list[tuple[int, int]]:
    """Byte stretches under the repeated units of one text, if long enough; cuts are its own."""
    chunks = len(cuts) - 1
    hit = np.zeros(chunks + 1, np.int64)
    for k in repeated:
        hit[k] += 1
        hit[min(k + RUN, chunks)] -= 1
    covered = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    spans = [(int(cuts[a]), int(cuts[b])) for a, b in zip(edges[::2], edges[1::2])]
    return [(a, b) for a, b in spans if b - a >= LEAST]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input (text, repeated units or null, carried row): the text without its repeated stretches."""
    for batch in batches:
        for part in slices(batch):
            texts, lists = part.column(0), part.column(1)
            data, offsets = text_bytes(texts)
            cuts = gear_cuts(data, offsets)
            first = np.searchsorted(cuts[:-1], offsets)
            new, removed, spans_of = [], [], []
            for k in range(part.num_rows):
                repeated = lists[k].values if lists[k].is_valid else None
                spans = []
                if repeated is not None and len(repeated):
                    own = np.append(cuts[first[k]:first[k + 1]], offsets[k + 1]) - offsets[k]
                    spans = removed_stretches(own, repeated.to_numpy())
                if spans:
                    raw, out, at = data[offsets[k]:offsets[k + 1]].tobytes(), [], 0
                    for a, b in spans:
                        out.append(raw[at:a])
                        at = b
                    new.append(b"".join([*out, raw[at:]]).decode())
                else:
                    new.append(None)
                removed.append(sum(b - a for a, b in spans))
                spans_of.append(len(spans))
            changed = pa.array([x is not None for x in new])
            kept = pc.if_else(changed, pa.array(new, texts.type), texts)
            yield pa.RecordBatch.from_arrays(
                [kept, pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans_of, pa.int64()),
                 part.column(2)],
                names=["text", "n_bytes", "n_removed", "n_spans", part.schema.names[2]],
            )


def _document_key(frame: DataFrame) -> DataFrame:
    return frame.withColumn("dk", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"))


def repeated_units(docs: DataFrame) -> DataFrame:
    """``(dk, repeated)``: per document (by the hash of its id and text) its units that are repeats."""
    spark = docs.sparkSession
    found = _document_key(documents_of(docs)).select("doc_id", "dk", "text").mapInArrow(_units, UNITS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartition(parts, "key").sortWithinPartitions(
        "key", F.col("doc_id").asc_nulls_last(), "dk", "at"
    )
    again = ordered.select("key", "dk", "at", "known").mapInArrow(_repeats, "dk long, at int")
    return again.groupBy("dk").agg(F.collect_set("at").alias("repeated"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, text)`` per document; text is what stays."""
    frame = _document_key(documents_of(docs)).join(repeated_units(docs), "dk", "left")
    rows = frame.select("text", "repeated", F.struct("doc_id").alias("row"))
    done = rows.mapInArrow(_remove, "text string, n_bytes long, n_removed long, n_spans long, row struct<doc_id:long>")
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "text")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated stretches; other columns stay."""
    place = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))
    text, packed = F.col("`" + docs.columns[place] + "`").cast("string"), "row"
    (pad,) = fresh(docs, "_pad")
    rest = [c for k, c in enumerate(docs.columns) if k != place]
    none = text.isNull().alias(pad)
    frame = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        F.struct(*quoted(rest), none).alias(packed),
    )
    frame = _document_key(frame).join(repeated_units(docs), "dk", "left").select("text", "repeated", packed)
    schema = frame.select(
        "text", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], packed
    ).schema
    done = frame.mapInArrow(_remove, schema)
    new = F.when(F.col(packed).getField(pad), F.lit(None).cast("string")).otherwise(F.col("text"))
    inner = {c: F.col(packed).getField(c).alias(c) for c in rest}
    return done.select(*[new.alias(c) if k == place else inner[c] for k, c in enumerate(docs.columns)])
