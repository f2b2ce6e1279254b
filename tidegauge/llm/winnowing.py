"""Document fingerprints by winnowing: the least k-gram hash of every window, with its position.

Hashes of all k-grams of code points are formed by doubling; in each window of ``WINDOW`` neighbouring
k-grams the least hash is chosen, the rightmost one on ties. Two texts that share a passage of
``GRAM + WINDOW - 1`` code points therefore share a chosen hash. Positions are kept beside the hashes.
A text shorter than a k-gram counts as one k-gram; a text with fewer k-grams than a window as one
window; the empty text has no fingerprint.

:func:`compare_with_next` walks the documents by descending id and compares each with an edited
form of itself and with its neighbour. The order is cut into ranges by quantiles of the ids (an id that fills whole
ranges is cut by its texts' hashes), and the first document of each range is also dealt to the range before it, so texts
move once.

Defined results: a null text is empty; documents without an id come last; documents with one id
are ordered by the hash of their texts; repeated rows are neighbours of each other; a single
document is its own neighbour. Two empty fingerprints are alike (1.0), an empty and another are not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import SLICE_BYTES, documents_of, mix, pair, slices

# Length of a k-gram in code points (a power of two) and k-grams in a window.
GRAM = 16
WINDOW = 48
_PAD = 0x1FFFFF
_NONE = np.uint64(2**64 - 1)


def winnow(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) of all texts, their positions, and the n + 1 offsets of the texts in them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    room = sizes + GRAM + WINDOW
    at = np.concatenate([[0], np.cumsum(room)])
    if at[-1] >= 2**32:
        raise ValueError("too many code points in one call")
    letters = np.full(at[-1] + WINDOW, _PAD, np.uint64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.arange(len(points)) + np.repeat(at[:-1] - (np.cumsum(sizes) - sizes), sizes)
    letters[inside] = points
    hashes, step = mix(letters), 1
    while step < GRAM:
        hashes[:-step] = pair(hashes[:-step], hashes[step:])
        step *= 2
    grams = np.where(sizes > 0, np.maximum(1, sizes - GRAM + 1), 0)
    keys = np.full(len(letters), _NONE, np.uint64)
    place = np.arange(grams.sum()) + np.repeat(at[:-1] - (np.cumsum(grams) - grams), grams)
    keys[place] = (hashes[place] >> np.uint64(32) << np.uint64(32)) | (np.uint64(2**32 - 1) - place.astype(np.uint64))
    least, width = keys, 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    if width < WINDOW:
        rest = WINDOW - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
    windows = np.where(sizes > 0, np.maximum(1, grams - WINDOW + 1), 0)
    first = np.cumsum(windows) - windows
    chosen = least[np.arange(windows.sum()) + np.repeat(at[:-1] - first, windows)]
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    new[first[windows > 0]] = True
    picked = np.flatnonzero(new)
    offsets = np.searchsorted(picked, np.append(first, len(chosen)))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    values = chosen[picked]
    positions = (np.uint64(2**32 - 1) - (values & np.uint64(2**32 - 1))).astype(np.int64) - at[owner]
    return (values >> np.uint64(32)).astype(np.uint32), positions, offsets


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, hashes, positions)`` of every document, in order of position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, positions, offsets = winnow(part.column(1).to_pylist())
                where = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(where, pa.array(hashes.astype(np.int64))),
                        pa.ListArray.from_arrays(where, pa.array(positions.astype(np.int32))),
                    ],
                    names=["doc_id", "hashes", "positions"],
                )

    return documents_of(docs).mapInArrow(run, "doc_id long, hashes array<long>, positions array<int>")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COMPARED = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
    "n_fingerprints long, near_edited double, near_next double"
)


Key = tuple[int | None, int]


def _range_bounds(frame: DataFrame, ranges: int) -> list[Key]:
    """``(doc_id, tie)`` from which each range but the last starts, descending; about ``ranges`` of them.

    Quantiles of the ids; an id that spans whole ranges, or the lack of one, is cut by the hashes of its texts.
    """
    shares = [k / ranges for k in range(1, ranges)]
    if not shares:
        return []
    ids = F.col("doc_id")
    found = frame.agg(
        F.percentile_approx(ids, shares).alias("cuts"), F.count(F.lit(1)).alias("n"), F.count_if(ids.isNull()).alias("none")
    ).first()  # one value per range
    cuts = found["cuts"] or []
    bounds: set[Key] = {(cut, _LEAST) for cut in cuts}
    busy = {cut for cut in cuts if cuts.count(cut) > 1}
    crowd = ids.isin(*busy) if busy else F.lit(False)
    if found["none"] * ranges > found["n"]:
        crowd = crowd | ids.isNull()
    elif not busy:
        return sorted(bounds, key=_order, reverse=True)
    ties = frame.where(crowd).groupBy("doc_id").agg(F.percentile_approx("tie", shares).alias("cuts"), F.count(F.lit(1)).alias("n"))
    for row in ties.collect():  # ids that span a range: at most one per range
        step = max(1, found["n"] // max(1, row["n"]))
        bounds |= {(row["doc_id"], cut) for cut in row["cuts"][::step]}
    return sorted(bounds, key=_order, reverse=True)


_LEAST = -(2**63)


def _order(key: Key) -> tuple[bool, int, int]:
    """No id comes before all ids, as in Spark's order of structs."""
    return key[0] is not None, key[0] or 0, key[1]


def _key_literals(keys: list[Key]) -> Column:
    one = lambda k: F.struct(F.lit(k[0]).cast("long").alias("doc_id"), F.lit(k[1]).cast("long").alias("tie"))
    return F.array(*[one(k) for k in keys])


def _range_of(key: Column, bounds: list[Key]) -> Column:
    """Number of bounds above the key: whole blocks of bounds first, then one by one in the block."""
    if not bounds:
        return F.lit(0)
    block = math.isqrt(len(bounds) - 1) + 1
    lasts = _key_literals(bounds[block - 1::block]) if len(bounds) >= block else None
    blocks = F.array(*[_key_literals(bounds[k:k + block]) for k in range(0, len(bounds), block)])
    above = lambda keys: F.size(F.filter(keys, lambda b: b > key))
    passed = above(lasts) if lasts is not None else F.lit(0)
    inside = F.coalesce(above(F.get(blocks, passed)), F.lit(0))
    return passed * block + F.greatest(inside, F.lit(0))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by descending id."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = documents_of(docs).withColumn("tie", F.xxhash64("text"))
    bounds = _range_bounds(frame, ranges)
    key = F.struct("doc_id", "tie")
    frame = frame.withColumn("part", _range_of(key, bounds).cast("int"))
    first = frame.groupBy("part").agg(F.max(key).alias("head"))
    heads = sorted((r["part"], r["head"]["doc_id"], r["head"]["tie"]) for r in first.collect())  # one per range
    place = F.lit(None).cast("int")
    if heads:
        # a range's head is also dealt to the last range before it that has rows; the very first to the very last
        by_part = {p: (i, t) for p, i, t in heads}
        last, before, keys = heads[-1][0], [], []
        for p in range(heads[-1][0] + 1):
            before.append(last)
            keys.append(by_part.get(p, (None, 0)))
            last = p if p in by_part else last
        head = F.get(_key_literals(keys), F.col("part"))
        place = F.when(head.eqNullSafe(key), F.get(F.array(*[F.lit(b).cast("int") for b in before]), F.col("part")))
    dealt = F.when(place.isNotNull(), F.array(F.col("part"), place)).otherwise(F.array("part"))
    places = frame.select("doc_id", "tie", "text", F.posexplode(dealt).alias("guest", "part"))
    ordered = places.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(
        "part", "guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()
    )
    return ordered.select("part", "guest", "doc_id", "text").mapInArrow(_compare, COMPARED)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, then the head of the next range."""
    held: list[tuple[int, int, int | None, str]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            held.append(row)
            size += len(row[3])
            if size >= SLICE_BYTES // 2:
                yield from _compared(held)
                held = [held[-1]]
                size = len(row[3])
    yield from _compared(held)


def _compared(rows: list[tuple[int, int, int | None, str]]) -> Iterator[pa.RecordBatch]:
    pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
    if not pairs:
        return
    texts = [r[3] for r in rows]
    new = [edited(texts[k], texts[k + 1]) for k in pairs]
    own, _, own_at = winnow(texts)
    other, _, other_at = winnow(new)
    own_bytes, other_bytes = own.astype(">u4").tobytes(), other.astype(">u4").tobytes()
    distinct = [np.unique(own[own_at[k]:own_at[k + 1]]) for k in range(len(rows))]
    columns: list[list] = [[] for _ in range(8)]
    for n, k in enumerate(pairs):
        a, b, c, d = own_at[k], own_at[k + 1], other_at[n], other_at[n + 1]
        values = (
            rows[k][2], len(texts[k]), new[n], own_bytes[4 * a:4 * b].hex(), other_bytes[4 * c:4 * d].hex(), int(b - a),
            likeness(distinct[k], np.unique(other[c:d])), likeness(distinct[k], distinct[k + 1]),
        )
        for column, value in zip(columns, values):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in COMPARED.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
