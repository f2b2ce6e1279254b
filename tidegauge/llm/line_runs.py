"""Line dedup over levelled sorted runs of line digests.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of at least
``LEAST_POINTS`` code points take part. The texts are scanned once for the 128-bit digests of their
keys, which are then taken in by batches of descending document id. A run is a table sorted by digest with at
most ``LEAST_DOCS`` rows a digest, the largest documents that hold it. A batch is merge-anti-joined with the
digests that the runs already hold ``LEAST_DOCS`` times (larger documents, so nothing of the batch
can change them), and what is left becomes a run of level 0. ``FAN_IN`` runs of a level are merged into
one of the next. In the end all runs are merged: a digest with ``LEAST_DOCS`` rows loses its lines in all
documents but the largest.

A line that a third of all documents hold is sent once per slice of some 4 MB; slices in which it is
crowded are thinned by salted groups first, and later batches leave it at the anti-join.

Defined results: a null or empty text is one empty line; rows with one id are one document (each row is
cut for itself), rows without an id together one that is smaller than all others; repeated rows get equal results;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm.common import documents_of, slices
from tidegauge.session import scratch_path, through_table

LEAST_POINTS = 40
LEAST_DOCS = 5
# Batches of a corpus, runs that make a level full, and groups of a digest that is crowded in a slice.
BATCHES = 4
FAN_IN = 2
SALTS = 32
# Bytes of a digest.
KEY_BYTES = 16
SPACE = b" \t\n\x0b\x0c\r"

SEEN = "key binary, docs array<long>, batch int"
RUN = "key binary, doc_id long, place int"
CUT = "doc_id long, n_lines long, n_dropped long, text string"


def line_key(line: bytes) -> bytes | None:
    """Digest of a line's key, or none if the key is too short."""
    line = line.strip(SPACE)
    if len(line) < LEAST_POINTS or not line.isascii() and len(line.decode()) < LEAST_POINTS:
        return None
    return hashlib.blake2b(line.lower(), digest_size=KEY_BYTES).digest()  # bytes: A-Z only


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests in a slice of texts, each with the documents of a batch that hold it, largest first."""
    for batch in batches:
        for part in slices(batch, "text"):
            found: dict[tuple[int, bytes], set] = {}
            ids, texts, ages = (part.column(k) for k in range(3))
            for doc, text, age in zip(ids.to_pylist(), texts.cast(pa.large_binary()), ages.to_pylist()):
                for line in text.as_py().split(b"\n"):
                    if len(line) >= LEAST_POINTS and (key := line_key(line)) is not None:
                        found.setdefault((age, key), set()).add(doc)
            docs = [sorted(d, key=lambda x: (x is not None, x), reverse=True) for d in found.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for _, k in found], pa.binary()), pa.array(docs, pa.list_(pa.int64())),
                    pa.array([a for a, _ in found], pa.int32()),
                ],
                names=["key", "docs", "batch"],
            )


def _changes(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one before it, nulls being equal to each other."""
    filled = pa.chunked_array([pa.array([last.as_py() if last is not None else None], column.type), column]).combine_chunks()
    a, b = filled[:-1], filled[1:]
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    both = pc.and_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    out = ~(same | both)
    if last is None and len(out):
        out[0] = True
    return out


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and descending document the first few documents of each key."""
    key = doc = None
    upto = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, docs = batch.column(0), batch.column(1)
        new_key = _changes(keys, key)
        new_doc = new_key | _changes(docs, doc)
        count = np.cumsum(new_doc)
        heads = np.flatnonzero(new_key)
        base = np.full(len(count), -upto, np.int64)
        if len(heads):
            owner = np.cumsum(new_key) - 1
            base = np.where(owner >= 0, count[heads[np.maximum(owner, 0)]] - 1, base)
        place = count - base
        keep = pa.array(np.flatnonzero(new_doc & (place <= LEAST_DOCS)))
        key, doc, upto = keys[len(keys) - 1], docs[len(docs) - 1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [keys.take(keep), docs.take(keep), pa.array(place.astype(np.int32)).take(keep)], names=["key", "doc_id", "place"]
        )


def _largest(rows: DataFrame) -> DataFrame:
    """The largest few documents of each key, sorted by key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("key", "doc_id").repartition(parts, "key").sortWithinPartitions(
        "key", F.col("doc_id").desc_nulls_last()
    )
    return ordered.mapInArrow(_first_places, RUN)


class LineRuns:
    """Sorted runs by level, in the shared folder; batches must come by descending document id."""

    def __init__(self, fan_in: int = FAN_IN) -> None:
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, rows: DataFrame) -> None:
        """Take in ``(key, doc_id)`` rows: those of keys not yet settled become a run."""
        fresh = _largest(rows)
        for run in self.runs():
            settled = run.where(F.col("place") == LEAST_DOCS).select("key")
            fresh = fresh.join(settled.hint("merge"), "key", "left_anti")
        self._push(0, through_table(fresh, "line-run"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged = through_table(self._merged(self.levels[level]), "line-run")
            self.levels[level] = []
            self._push(level + 1, merged)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        whole = runs[0]
        for run in runs[1:]:
            whole = whole.unionByName(run)
        return _largest(whole) if len(runs) > 1 else whole

    def repeated(self) -> DataFrame:
        """``(key, keeper)`` of all keys that enough documents hold."""
        by_key = self._merged(self.runs()).groupBy("key").agg(F.max("doc_id").alias("keeper"), F.max("place").alias("n"))
        return by_key.where(F.col("n") >= LEAST_DOCS).select("key", "keeper")


def scan(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``(key, docs, batch)``: digests by slice with the documents that hold them; batch 0 has the largest ids."""
    frame = documents_of(docs)
    shares = [k / batches for k in range(1, batches)]
    cuts = frame.agg(F.percentile_approx("doc_id", shares).alias("c")).first()["c"] if shares else []  # one per batch
    above = F.lit(0)
    for cut in sorted(set(cuts or [])):
        above = above + F.when(F.col("doc_id") >= cut, 0).otherwise(1)
    return frame.select("doc_id", "text", above.cast("int").alias("batch")).mapInArrow(_seen, SEEN)


def _rows(seen: DataFrame) -> DataFrame:
    """``(key, doc_id)``; keys crowded in a slice are thinned by groups before they meet."""
    few = F.size("docs") < LEAST_DOCS
    single = seen.where(few).select("key", F.explode("docs").alias("doc_id"))
    crowd = seen.where(~few).select("key", F.explode(F.slice("docs", 1, LEAST_DOCS)).alias("doc_id"))
    salt = F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), 2, "0"))
    thinned = _largest(crowd.select(F.concat("key", salt).alias("key"), "doc_id"))
    return single.unionByName(thinned.select(F.substring("key", 1, KEY_BYTES).alias("key"), "doc_id"))


def drop_repeated(docs: DataFrame, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` of every document; text is what stays."""
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark, "line-digests")
    scan(docs, batches).write.partitionBy("batch").parquet(path)
    seen = spark.read.schema(SEEN).parquet(path)
    store = LineRuns(fan_in)
    for number in range(batches):
        store.add(_rows(seen.where(F.col("batch") == number)))
    met = seen.join(store.repeated(), "key")
    others = F.filter("docs", lambda d: d.isNull() | (d != F.col("keeper")))
    lost = met.select("key", F.explode(others).alias("lost_id")).groupBy("lost_id").agg(F.collect_list("key").alias("keys"))
    frame = documents_of(docs)
    joined = frame.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left").select("doc_id", "text", "keys")
    return joined.mapInArrow(_cut, CUT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose keys are listed beside them."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts, lists = part.column(1).cast(pa.large_binary()), part.column(2)
            n_lines = pc.add(pc.count_substring(texts, b"\n"), 1)
            new, dropped = [], np.zeros(part.num_rows, np.int64)
            has = lists.is_valid().to_pylist()
            for k, cut in enumerate(has):
                if not cut:
                    new.append(None)
                    continue
                keys = set(lists[k].as_py())
                lines = texts[k].as_py().split(b"\n")
                kept = [x for x in lines if len(x) < LEAST_POINTS or line_key(x) not in keys]
                dropped[k] = len(lines) - len(kept)
                new.append(b"\n".join(kept))
            out = pc.if_else(pa.array(has), pa.array(new, texts.type), texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), n_lines.cast(pa.int64()), pa.array(dropped), out.cast(pa.large_string())],
                names=["doc_id", "n_lines", "n_dropped", "text"],
            )
