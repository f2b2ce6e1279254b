"""What the corpus operators share: the columns they read, fresh names, byte and word views of Arrow batches.

Every operator here treats a null text as the empty text, keeps repeated rows apart, accepts
empty tables and ignores columns other than ``doc_id`` and ``text``, whatever their names are.
Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A batch of texts is worked through in slices of at most so many bytes (one text may exceed it).
SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096
# Rows of whole texts in one Arrow batch; long texts make rows heavy.
BATCH_ROWS = 512


def documents_of(docs: DataFrame) -> DataFrame:
    """``(doc_id long, text string)`` with null texts as empty ones; all other columns go."""
    return docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"),
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The given ``documents`` table, in small Arrow batches because its rows are whole texts."""
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings the corpus operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    _ship_package(spark)


_SHIPPED: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), os.path.basename(package))
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(context.applicationId)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of the frame has it in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """The columns of that name, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Parts of a batch with about ``most`` bytes of text each, in order."""
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        stop = min(stop, start + SLICE_ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and the n + 1 offsets of the texts."""
    texts = texts.cast(pa.large_binary())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift rounds), in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit identifier for each ordered pair of identifiers."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the joined bytes, and the n + 1 offsets of the texts' words."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = heads[1:] - 1 if len(heads) else heads
    ends[tails] = inside[tails]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from the 8-byte pieces of its bytes."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    low = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(starts), np.uint64)
    at, left = starts.copy(), (ends - starts).copy()
    rows = np.arange(len(starts))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    while len(rows):
        piece = np.ascontiguousarray(low[at]).view(np.uint64).ravel() & keep[np.minimum(left, 8)]
        out[rows] = pair(out[rows] + np.minimum(left, 8).astype(np.uint64), piece)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out
