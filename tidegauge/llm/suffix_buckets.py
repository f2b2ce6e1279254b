"""Exact removal of long repeated byte strings by refining buckets of suffixes.

Every start of a ``LENGTH``-byte string is a suffix to be bucketed by its first ``LENGTH`` bytes. The
bucket identifier of a ``2d``-byte string is formed from the identifiers of its two halves, as in
bucket-pointer refinement, where a bucket is refined by the identifiers found at a later offset;
identifiers are 64-bit fingerprints, so they agree in all tasks. From 8 bytes the refinement goes
to 16, 32, 64, 128 and, with overlapping halves, 200.

Most suffixes leave at the 64-byte level. Of all 64-byte strings inside a long string the one with
the least identifier stands for it (the rightmost on ties), so equal long strings have the same
one. Only these anchors are sorted into global buckets; an anchor alone in its bucket settles all
long strings it stands for. The texts around the remaining anchors meet by bucket and are refined
to full length there. Buckets with very many anchors are refined suffix by suffix instead, spread
by the final identifier, with repeats inside a batch sent once. Nothing is cut or capped.

Texts with equal copies are repeats as a whole; one of each takes part as a partner for others.

Defined results: a null or empty text has nothing to remove; texts shorter than ``LENGTH`` bytes
never repeat; equal rows are copies of each other; bytes of any text are whole UTF-8, what
remains may not be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import documents_of, mix, pair, slices, text_bytes
from tidegauge.session import through_table

LENGTH = 200
ANCHOR = 64
WINDOW = LENGTH - ANCHOR + 1
# Equal anchors in one batch, and in one bucket, from which a bucket is refined suffix by suffix.
BATCH_HOT = 16
BUCKET_HOT = 1000
# Anchors refined together in one go.
CHUNK = 8000

ENTRIES = "key long, kind byte, tk long, at int"
FOUND = "tk long, at int, hot boolean"
CONTEXTS = "key long, tk long, low int, windows int, context binary"
RUNS = "tk long, first int, last int"


def refined(data: np.ndarray, upto: int) -> np.ndarray:
    """Bucket identifiers of the ``upto``-byte strings at all starts (a power of two from 8)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    width = 8
    ids = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:max(0, len(data) - 7)])
    ids = mix(ids.view(np.uint64).ravel() + np.uint64(1))
    while width < upto:
        ids = pair(ids[:-width], ids[width:]) if len(ids) > width else ids[:0]
        width *= 2
    return ids


def refined_fully(ids: np.ndarray) -> np.ndarray:
    """Identifiers of the ``LENGTH``-byte strings from those of ``ANCHOR`` bytes, by later offsets."""
    double = pair(ids[:-ANCHOR], ids[ANCHOR:]) if len(ids) > ANCHOR else ids[:0]
    offset = LENGTH - 2 * ANCHOR
    return pair(double[:-offset], double[offset:]) if len(double) > offset else double[:0]


def anchors(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, place, first and last long string of every anchor; places are in the joined bytes."""
    n = len(ids)
    low = np.uint64(2**32 - 1)  # a place; equal identifiers' upper halves are told apart by it
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none
    keys = (ids & ~low) | (low - np.arange(n, dtype=np.uint64))
    width = 1
    while width * 2 <= WINDOW:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = WINDOW - width
    if rest:
        keys = np.minimum(keys[:-rest], keys[rest:])
    sizes = np.diff(offsets)
    counts = np.maximum(0, sizes - LENGTH + 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    starts = np.arange(len(owner)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    places = (low - (keys[starts] & low)).astype(np.int64)
    if not len(places):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (owner[1:] != owner[:-1])]))
    ends = np.append(new[1:], len(places)) - 1
    return owner[new], places[new], starts[new], starts[ends]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of every text. Kind 0: an anchor; 1: a bucket that is hot in a batch; 2: an anchor of such."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column(1))
            ids = refined(data, ANCHOR)
            owner, place, _, _ = anchors(data, offsets, ids)
            if not len(owner):
                continue
            key = ids[place].view(np.int64)
            tk = part.column(0).to_numpy()[owner]
            at = (place - offsets[:-1][owner]).astype(np.int32)
            # equal texts in a batch speak once
            by = np.lexsort((at, tk, key))
            key, tk, at = key[by], tk[by], at[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (tk[1:] != tk[:-1]) | (at[1:] != at[:-1])
            key, tk, at = key[new], tk[new], at[new]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff(np.append(heads, len(key)))
            hot = np.repeat(counts >= BATCH_HOT, counts)
            marks = heads[counts >= BATCH_HOT]
            kind = np.where(hot, 2, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.where(hot, tk, key), key[marks]])),
                    pa.array(np.concatenate([kind, np.ones(len(marks), np.int64)]).astype(np.int8)),
                    pa.array(np.concatenate([tk, np.zeros(len(marks), np.int64)])),
                    pa.array(np.concatenate([at, np.zeros(len(marks), np.int32)])),
                ],
                names=["key", "kind", "tk", "at"],
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by key and kind (hot marks first): anchors that are not alone in their bucket."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
        held.append(rows)
        if rows[-1, 0] != held[0][0, 0]:
            whole = np.concatenate(held)
            cut = int(np.searchsorted(whole[:, 0], whole[-1, 0]))
            yield _shared_groups(whole[:cut])
            held = [whole[cut:]]
    if held:
        yield _shared_groups(np.concatenate(held))


def _shared_groups(rows: np.ndarray) -> pa.RecordBatch:
    known = rows[:, 1] == 2
    asked = rows[~known]
    keep, hot = np.zeros(len(asked), bool), np.zeros(len(asked), bool)
    if len(asked):
        # the same anchor of equal texts in several batches is one
        twin = np.zeros(len(asked), bool)
        twin[1:] = (asked[1:] == asked[:-1]).all(axis=1) & (asked[1:, 1] == 0)
        asked = asked[~twin]
        heads = np.flatnonzero(np.concatenate([[True], asked[1:, 0] != asked[:-1, 0]]))
        counts = np.diff(np.append(heads, len(asked)))
        marked = np.add.reduceat((asked[:, 1] == 1).astype(np.int64), heads) > 0
        keep = np.repeat((counts > 1) | marked, counts) & (asked[:, 1] == 0)
        hot = np.repeat(marked | (counts > BUCKET_HOT), counts)
        asked, hot = asked[keep], hot[keep]
    out = np.concatenate([asked, rows[known]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(out[:, 2]), pa.array(out[:, 3].astype(np.int32)),
            pa.array(np.concatenate([hot, np.ones(int(known.sum()), bool)])),
        ],
        names=["tk", "at", "hot"],
    )


def _candidates(part: pa.RecordBatch, hot: bool) -> Iterator[tuple]:
    """Bytes, offsets, identifiers and the (hot or other) shared anchors of a part of (tk, ats, hots, text)."""
    data, offsets = text_bytes(part.column(3))
    ids = refined(data, ANCHOR)
    owner, place, first, last = anchors(data, offsets, ids)
    lists, flags = part.column(1), part.column(2)
    counts = pc.list_value_length(lists).to_numpy()
    wanted = np.repeat(offsets[:-1], counts) + lists.flatten().to_numpy().astype(np.int64)
    wanted = wanted[flags.flatten().to_numpy(zero_copy_only=False) == hot]
    chosen = np.isin(place, wanted)
    yield data, offsets, ids, owner[chosen], place[chosen], first[chosen], last[chosen]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every shared anchor the bytes of all long strings it stands for."""
    for batch in batches:
        for part in slices(batch):
            for data, offsets, ids, owner, place, first, last in _candidates(part, False):
                if not len(owner):
                    continue
                sizes = last - first + LENGTH
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                taken = data[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[place].view(np.int64)), pa.array(part.column(0).to_numpy()[owner]),
                        pa.array((first - offsets[:-1][owner]).astype(np.int32)),
                        pa.array((last - first + 1).astype(np.int32)),
                        pa.BinaryArray.from_buffers(
                            pa.binary(), len(owner),
                            [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken))],
                        ),
                    ],
                    names=["key", "tk", "low", "windows", "context"],
                )


def _as_runs(tk: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Long strings sorted by text and start, as runs of neighbouring ones."""
    if not len(tk):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())],
                                          names=["tk", "first", "last"])
    new = np.flatnonzero(np.concatenate([[True], (tk[1:] != tk[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    ends = np.append(new[1:], len(tk)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(tk[new]), pa.array(starts[new].astype(np.int32)), pa.array(starts[ends].astype(np.int32))],
        names=["tk", "first", "last"],
    )


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by bucket: the long strings of each bucket that occur twice or more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = table.column(0).to_numpy()
            cut = int(np.flatnonzero(keys == keys[-1])[0])
            if cut:
                yield _refine_chunk(table.slice(0, cut))
                held = [table.slice(cut)]
                n = table.num_rows - cut
    if held:
        yield _refine_chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _refine_chunk(rows: pa.RecordBatch) -> pa.RecordBatch:
    key, tk, low, windows = (rows.column(k).to_numpy().astype(np.int64) for k in range(4))
    data, offsets = text_bytes(rows.column(4))
    ids = refined_fully(refined(data, ANCHOR))
    owner = np.repeat(np.arange(len(key)), windows)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    full = pair(ids[offsets[:-1][owner] + step], key.view(np.uint64)[owner])
    order = np.argsort(full, kind="stable")
    equal = full[order][1:] == full[order][:-1]
    twice = np.zeros(len(full), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    return _sorted_runs(tk[owner][twice], (low[owner] + step)[twice])


def _sorted_runs(tk: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((starts, tk))
    return _as_runs(tk[order], starts[order])


PACKED = "part int, keys array<long>, tks array<long>, starts array<int>, known array<boolean>"


def _hot_suffixes(parts: int):
    """Long strings of hot anchors, dealt to ``parts`` by identifier; repeats in a batch are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for data, offsets, ids, owner, place, first, last in _candidates(part, True):
                    if not len(owner):
                        continue
                    windows = last - first + 1
                    who = np.repeat(np.arange(len(owner)), windows)
                    start = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
                    full = pair(refined_fully(ids)[start], ids[place][who])
                    tk = part.column(0).to_numpy()[owner][who]
                    start = start - offsets[:-1][owner][who]
                    order = np.argsort(full, kind="stable")
                    full, tk, start = full[order], tk[order], start[order]
                    heads = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
                    counts = np.diff(np.append(heads, len(full)))
                    repeated = np.repeat(counts > 1, counts)
                    # strings repeated here are settled: kept as runs under part -1
                    runs = _sorted_runs(tk[repeated], start[repeated])
                    yield _packed([-1], [runs.column(1).to_numpy().astype(np.int64)], [runs.column(0).to_numpy()],
                                  [runs.column(2).to_numpy()], [np.ones(runs.num_rows, bool)])
                    full, tk, start, counts = full[heads], tk[heads], start[heads], counts
                    goes = (full % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(goes, kind="stable")
                    bounds = np.searchsorted(goes[order], np.arange(parts + 1))
                    filled = np.flatnonzero(np.diff(bounds))
                    chosen = [order[bounds[p]:bounds[p + 1]] for p in filled]
                    yield _packed(filled, [full[c].view(np.int64) for c in chosen], [tk[c] for c in chosen],
                                  [start[c] for c in chosen], [counts[c] > 1 for c in chosen])

    return run


def _packed(part, *columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    lists = []
    for values, kind in zip(columns, kinds):
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        flat = np.concatenate(values) if len(values) else np.zeros(0, np.int64)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(part, np.int32)), *lists], names=["part", "keys", "tks", "starts", "known"]
    )


def _hot_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of a part: those that came from two batches or are known to repeat in one."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    key, tk, start, known = (
        table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in ("keys", "tks", "starts", "known")
    )
    order = np.argsort(key, kind="stable")
    key, tk, start, known = key[order], tk[order], start[order], known[order]
    if len(key):
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(heads, len(key)))
        twice = np.repeat((counts > 1) | (np.add.reduceat(known.astype(np.int64), heads) > 0), counts)
        yield _sorted_runs(tk[twice], start[twice].astype(np.int64))


RESULT = "tk long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input (tk, text, runs): what stays of each text."""
    for batch in batches:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            raw = batch.column(1)[k].as_py().encode()
            hit = np.zeros(len(raw) + 1, np.int64)
            runs = batch.column(2)[k].values
            np.add.at(hit, runs.field(0).to_numpy(), 1)
            np.add.at(hit, np.minimum(runs.field(1).to_numpy() + LENGTH, len(raw)), -1)
            covered = np.cumsum(hit[:-1]) > 0
            spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
            out.append((batch.column(0)[k].as_py(), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
        if out:
            columns = [list(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.string())],
                names=["tk", "n_removed", "n_spans", "kept_sha256"],
            )


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tk, text)`` of the texts with shared anchors, and ``(tk, first, last)``: starts of repeated strings."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = documents_of(docs).where(F.octet_length("text") >= LENGTH).select(F.xxhash64("text").alias("tk"), "text")
    entries = frame.mapInArrow(_entries, ENTRIES)
    ordered = entries.repartition(parts, "key").sortWithinPartitions("key", F.desc("kind"), "tk", "at")
    shared = ordered.mapInArrow(_shared, FOUND)
    by_text = shared.groupBy("tk").agg(F.collect_set(F.struct("at", "hot")).alias("found"))
    by_text = by_text.select("tk", F.expr("transform(found, f -> f.at)").alias("ats"),
                             F.expr("transform(found, f -> f.hot)").alias("hots"))
    one_each = frame.groupBy("tk").agg(F.first("text").alias("text"))
    texts = through_table(one_each.join(by_text, "tk").select("tk", "ats", "hots", "text"), "suffix-texts")
    contexts = texts.mapInArrow(_contexts, CONTEXTS).repartition(parts, "key").sortWithinPartitions("key")
    refined_runs = contexts.mapInArrow(_refine, RUNS)
    hot_texts = texts.where(F.exists("hots", lambda h: h))
    packed = through_table(hot_texts.mapInArrow(_hot_suffixes(parts), PACKED), "suffix-hot")
    settled = packed.where("part = -1").select(
        F.explode(F.arrays_zip("tks", "keys", "starts")).alias("r")
    ).select("r.tks", F.col("r.keys").cast("int").alias("first"), F.col("r.starts").alias("last"))
    hot_runs = packed.where("part >= 0").repartition(parts, "part").mapInArrow(_hot_repeats, RUNS)
    runs = refined_runs.unionAll(settled.toDF("tk", "first", "last")).unionAll(hot_runs)
    return texts.select("tk", "text"), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document."""
    texts, runs = repeated_runs(docs)
    by_text = runs.groupBy("tk").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = through_table(texts.join(by_text, "tk").select("tk", "text", "runs").mapInArrow(_cut_out, RESULT), "suffix-cut")
    rows = documents_of(docs).select(
        "doc_id", F.xxhash64("text").alias("tk"), F.md5("text").alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"),
    )
    rows = through_table(rows, "suffix-rows")
    copied = rows.where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = through_table(copied.select("digest", F.lit(True).alias("copied")), "suffix-copies")
    rows = rows.join(copied, "digest", "left").join(cut, "tk", "left")
    whole, none = F.coalesce("copied", F.lit(False)), F.sha2(F.lit(""), 256)

    def value(if_copied, otherwise):
        return F.when(whole, if_copied).otherwise(otherwise)

    return rows.select(
        "doc_id", "n_bytes",
        value(F.col("n_bytes"), F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        value(F.lit(1), F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        value(none, F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
