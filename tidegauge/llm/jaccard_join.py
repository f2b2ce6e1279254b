"""Similarity join on word shingles by chosen paths.

Texts become sets of five-word shingles; equal sets are joined at once by their digests. In each of
``RUNS`` runs a set goes to the bucket of one of its shingles, the one that a random order of all
shingles puts first, so that two sets choose the same with the probability of their Jaccard
similarity. Buckets of one set are dropped. Small buckets are compared by brute force. Large ones
are split again on further sampled shingles, unless the splits show that most of their sets are
alike; those, and what is large after the last level, are compared tile against tile. The number
of runs at each level follows from the target recall for pairs at the threshold.

Brute force is exact and counts shingles in common. A pair that meets in several buckets counts
in the least of them only, so link counts need no list of pairs; each tile passes on a star per
group of linked sets, and groups are put together by contraction.

Defined results: a text with one to four words has one shingle, all its words; texts without
words (null ones among them) form one class; repeated rows are links of each other; class ids are
the least document id in the class (null only if no member has an id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import documents_of, fresh, mix, pair, quoted, slices, text_bytes, word_hashes, word_spans
from tidegauge.llm.components import components
from tidegauge.session import through_table

SHINGLE = 5
# The threshold as a fraction: intersection over union of 4/5 or more.
ALIKE, OF = 4, 5
TARGET_RECALL = 0.99999
RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - ALIKE / OF))
LEVELS = 3
# Sets in a bucket that is compared without further splits; sets and shingles in a tile.
SMALL = 64
TILE_SETS = 512
TILE_SHINGLES = 1_000_000
# Mean similarity in a bucket from which splitting it does not pay.
DENSE = 0.3
# Runs in the trial.
PROBES = 2
_COLUMNS = 4096

_TOKEN = np.uint64(2**52 - 1)
_FACTORS = mix(np.arange(1, 1 + RUNS * LEVELS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SIGNED = "doc_id long, tk long, ka long, kb long, n int, chosen array<long>"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (52-bit hashes) of all texts, sorted in each, and the texts' n + 1 offsets."""
    data, offsets = text_bytes(texts)
    starts, ends, words_at = word_spans(data, offsets)
    counts = np.diff(words_at)
    padded = np.zeros(len(starts) + SHINGLE * len(counts) + SHINGLE, np.uint64)
    own = np.arange(len(starts)) + SHINGLE * np.repeat(np.arange(len(counts)), counts)
    padded[own] = word_hashes(data, starts, ends)
    two = pair(padded[:-1], padded[1:])
    four = pair(two[:-2], two[2:])
    five = pair(four[:len(padded) - 4], padded[4:])
    n = np.where(counts > 0, np.maximum(1, counts - SHINGLE + 1), 0)
    first = np.concatenate([[0], np.cumsum(counts + SHINGLE)])[:-1]
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(n) - n), n)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(52)) | (five[at] & _TOKEN))
    return keys & _TOKEN, np.searchsorted(keys >> np.uint64(52), np.arange(len(counts) + 1, dtype=np.uint64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, size and chosen shingles of every text."""
    for batch in batches:
        for part in slices(batch):
            tokens, offsets = shingle_sets(part.column(2))
            sizes = np.diff(offsets)
            filled = np.flatnonzero(sizes)
            heads = offsets[:-1][filled]
            ka, kb = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            chosen = np.zeros((len(sizes), len(_FACTORS)), np.uint64)
            if len(filled):
                ka[filled] = np.add.reduceat(mix(tokens + np.uint64(1)), heads)
                kb[filled] = np.bitwise_xor.reduceat(mix(tokens + np.uint64(7)), heads)
                for k, factor in enumerate(_FACTORS):
                    order = tokens * factor
                    order ^= order >> np.uint64(31)
                    order *= np.uint64(0xBF58476D1CE4E5B9)
                    chosen[filled, k] = np.minimum.reduceat(order, heads)
            lists = np.where(sizes > 0, len(_FACTORS), 0)
            flat = chosen[filled].ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(ka.view(np.int64)), pa.array(kb.view(np.int64)),
                    pa.array(sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32)), pa.array(flat)
                    ),
                ],
                names=["doc_id", "tk", "ka", "kb", "n", "chosen"],
            )


def _split(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Send the sets of each bucket to their chosen shingles' buckets; those of one set alone are dropped.

    ``rows`` has path and set_id (path 0 for the start). Returns (parent, path, set_id, n, sets, shingles).
    """
    own = sets.select("set_id", "n", F.slice("chosen", level * RUNS + 1, RUNS).alias("chosen"))
    joined = own.withColumn("parent", F.lit(0).cast("long")) if level == 0 else (
        rows.select("set_id", F.col("path").alias("parent")).join(own, "set_id")
    )
    placed = joined.select("parent", "set_id", "n", F.posexplode("chosen").alias("run", "token"))
    placed = placed.select("parent", F.xxhash64("parent", "run", "token").alias("path"), "set_id", "n")
    sizes = placed.groupBy("path").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    shared = through_table(sizes.where("sets > 1"), "join-buckets")
    return through_table(placed.join(shared, "path"), "join-members")


def _dense(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Paths of the buckets whose sets are much alike, by a trial of few of the level's runs.

    The share of pairs that a run keeps together estimates the mean similarity in the bucket.
    """
    own = sets.select("set_id", F.slice("chosen", level * RUNS + 1, PROBES).alias("chosen"))
    tried = rows.select("path", "set_id", "sets").join(own, "set_id")
    tried = tried.select("path", "sets", F.posexplode("chosen").alias("run", "token"))
    together = tried.groupBy("path", "run", "token").agg(F.count(F.lit(1)).alias("c"), F.first("sets").alias("m"))
    judged = together.groupBy("path").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("kept"), F.first("m").alias("m"))
    dense = judged.where(F.col("kept") >= DENSE * PROBES * F.col("m") * (F.col("m") - 1))
    return through_table(dense.select("path"), "join-dense")


def _buckets(sets: DataFrame) -> DataFrame:
    """``(path, set_id, tiles)``: the buckets to compare by brute force; equal small buckets once."""
    rows, done = None, []
    for level in range(LEVELS):
        if level:
            dense = _dense(rows, sets, level)
            done.append(rows.join(dense, "path", "left_semi"))
            rows = rows.join(dense, "path", "left_anti")
        members = _split(rows, sets, level)
        small, large = members.where(F.col("sets") <= SMALL), members.where(F.col("sets") > SMALL)
        done.append(small)
        rows = large.select("path", "set_id", "n", "sets", "shingles")
        if rows.isEmpty():
            rows = None
            break
    if rows is not None:
        done.append(rows)
    found = done[0].select("path", "set_id", "sets", "shingles")
    for more in done[1:]:
        found = found.unionAll(more.select("path", "set_id", "sets", "shingles"))
    tiles = F.ceil(F.greatest(F.col("sets") / TILE_SETS, F.col("shingles") / TILE_SHINGLES)).cast("int").alias("tiles")
    found = found.select("path", "set_id", "sets", tiles)
    little = found.where((F.col("sets") <= SMALL) & (F.col("tiles") == 1))
    lists = little.groupBy("path").agg(F.sort_array(F.collect_list("set_id")).alias("members"))  # at most SMALL
    once = lists.groupBy("members").agg(F.min("path").alias("path")).select("path", F.explode("members").alias("set_id"))
    rest = found.where((F.col("sets") > SMALL) | (F.col("tiles") > 1)).select("path", "set_id", "tiles")
    return once.select("path", "set_id", F.lit(1).alias("tiles")).unionAll(rest)


TOKENS = "set_id long, copies long, buckets array<struct<path:long,tiles:int>>, tokens array<long>"
LINKED = "set_id long, root long, links long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            tokens, offsets = shingle_sets(part.column(3))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["set_id", "copies", "buckets", "tokens"])


def _common(rows: np.ndarray, columns: np.ndarray, m: int, wanted: int) -> np.ndarray:
    """For all pairs of m rows, the number of columns they share; entries are (row, column) pairs."""
    shared = np.zeros((m, m), np.float32)
    for start in range(0, wanted, _COLUMNS):
        inside = (columns >= start) & (columns < start + _COLUMNS)
        table = np.zeros((m, min(_COLUMNS, wanted - start)), np.float32)
        table[rows[inside], columns[inside] - start] = 1
        shared += table @ table.T
    return shared


def _incidence(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of every value that at least two of the lists hold."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, columns, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    keep = often[columns]
    return rows[keep], place[columns[keep]], int(often.sum())


def compare(path: int, cross: bool, tile: np.ndarray, ids: np.ndarray, copies: np.ndarray, tokens: list[np.ndarray],
            paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Linked sets of one bucket: their ids, the least set each hangs on, and links counted here.

    With ``cross`` only pairs from different tiles count; a tile may be empty.
    """
    if cross and len(np.unique(tile)) < 2:
        return None
    m = len(ids)
    sizes = np.array([len(t) for t in tokens], np.float64)
    shared = _common(*_incidence(tokens)[:2], m, _incidence(tokens)[2])
    alike = (ALIKE + OF) * shared.astype(np.float64) >= ALIKE * (sizes[:, None] + sizes[None, :])
    if cross:
        alike &= tile[:, None] != tile[None, :]
    np.fill_diagonal(alike, False)
    linked = np.flatnonzero(alike.any(axis=1))
    if not len(linked):
        return None
    alike = alike[np.ix_(linked, linked)]
    earlier = [paths[k][paths[k] < path] for k in linked]
    rows, columns, n = _incidence(earlier)
    counted = alike & (_common(rows, columns, len(linked), n) == 0) if n else alike
    links = counted @ copies[linked]
    root = ids[linked].copy()
    while True:
        least = np.minimum(root, np.where(alike, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            return ids[linked], root, links
        root = least


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force in each run of rows with one (path, low, high); rows come sorted by these."""
    held: list[tuple] = []
    key = None
    out: list[tuple[np.ndarray, ...]] = []

    def close() -> None:
        if len(held) > 1:
            tile, ids, copies, tokens, paths = zip(*held)
            found = compare(
                key[0], key[1] != key[2], np.array(tile), np.array(ids), np.array(copies, np.int64), list(tokens), list(paths)
            )
            if found is not None:
                out.append(found)

    def drain() -> Iterator[pa.RecordBatch]:
        if out:
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)]
            out.clear()
            yield pa.RecordBatch.from_arrays(columns, names=["set_id", "root", "links"])

    for batch in batches:
        path, low, high, tile, ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        tokens, paths = ([x.values.to_numpy() for x in batch.column(k)] for k in (6, 7))
        for k in range(batch.num_rows):
            now = (int(path[k]), int(low[k]), int(high[k]))
            if now != key:
                close()
                held, key = [], now
            held.append((int(tile[k]), int(ids[k]), int(copies[k]), tokens[k], paths[k]))
        if len(out) > 200:
            yield from drain()
    close()
    yield from drain()


def link(docs: DataFrame) -> DataFrame:
    """``(doc_id, tk, class_id, keeper, n_links, n_copies)``, one row per document.

    ``tk`` is the hash of the text; ``keeper`` marks one row of each class (and rows equal to it).
    """
    spark = docs.sparkSession
    frame = documents_of(docs).select("doc_id", F.xxhash64("text").alias("tk"), "text")
    signed = through_table(frame.mapInArrow(_sign, SIGNED), "join-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("first")
    sets = signed.groupBy("ka", "kb").agg(
        first, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("chosen").alias("chosen")
    )
    sets = sets.orderBy("first.none", "first.doc_id", "ka", "kb").withColumn("set_id", F.monotonically_increasing_id())
    sets = through_table(sets, "join-sets")

    buckets = through_table(_buckets(sets), "join-compare")
    leaves = buckets.groupBy("set_id").agg(F.collect_set(F.struct("path", "tiles")).alias("buckets"))
    wanted = leaves.join(sets.select("set_id", "copies", F.col("first.tk").alias("tk")), "set_id")
    texts = frame.groupBy("tk").agg(F.first("text").alias("text"))
    rows = texts.join(wanted, "tk").select("set_id", "copies", "buckets", "text").mapInArrow(_tokens, TOKENS)
    one = rows.select("set_id", "copies", "tokens", F.expr("transform(buckets, b -> b.path)").alias("paths"),
                      F.explode("buckets").alias("b"))
    tile = F.pmod(F.xxhash64("set_id"), F.col("b.tiles")).cast("int")
    one = one.select(F.col("b.path").alias("path"), tile.alias("tile"), "set_id", "copies", "tokens", "paths",
                     F.explode(F.sequence(F.lit(0), F.col("b.tiles") - 1)).alias("other"))
    one = one.select("path", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                     "tile", "set_id", "copies", "tokens", "paths")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = one.repartition(parts, "path", "low", "high").sortWithinPartitions("path", "low", "high")
    linked = through_table(grouped.mapInArrow(_compare_groups, LINKED), "join-linked")

    roots = components(linked.select("set_id", "root"), "set_id", "root")
    links = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = sets.select(F.col("set_id").alias("root"), F.col("first").alias("named"))
    known = through_table(roots.select(F.col("node").alias("set_id"), "root"), "join-roots").join(named, "root")
    result = sets.select("set_id", "ka", "kb", "copies", "first").join(links, "set_id", "left").join(
        known.select("set_id", "named"), "set_id", "left"
    )
    result = through_table(
        result.select("ka", "kb", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                      F.coalesce("named", "first").alias("named")), "join-result"
    )
    return signed.select("doc_id", "tk", "ka", "kb").join(result, ["ka", "kb"]).select(
        "doc_id", "tk", F.col("named.doc_id").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("named.doc_id")) & (F.col("tk") == F.col("named.tk"))).alias("keeper"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns."""
    key, check, packed = "key", "check", fresh(docs, "_row")[0]
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    identity = F.coalesce(F.col("`doc_id`").cast("string"), F.lit("-"))
    tk = F.xxhash64(text)
    keepers = link(docs).where("keeper").select(
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "tk").alias(key),
        F.hash("tk", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(check),
    ).distinct()
    rows = docs.select(
        F.xxhash64(identity, tk).alias(key), F.hash(tk, identity).alias(check), F.struct(*quoted(docs.columns)).alias(packed)
    )
    kept = rows.join(through_table(keepers, "join-keepers"), [key, check], "left_semi").dropDuplicates([key, check])
    return kept.select(*[F.col(packed).getField(c).alias(c) for c in docs.columns])
