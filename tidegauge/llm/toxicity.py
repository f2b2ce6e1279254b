"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature says whether an n-gram (hashed to ``SLOTS`` slots) occurs in the lower-cased text. Its
log-count ratio between toxic and other training texts scales it before logistic regression
learns the weights; a text's score then needs the sum of the weights of its distinct features.

Sample: per class, the ``SAMPLE`` labelled training rows with the smallest hashes of their ids;
the intercept is corrected to the class shares among all training labels. Every whole text is
scored, in one pass without a shuffle.

Defined results: a null or empty text has no features and gets the score of the intercept; rows
without an id count as held in (their id reads as the empty text); repeated rows get equal scores;
without labels of both classes every score is the share of toxic labels, or 0.5 without labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import documents_of, mix, slices
from tidegauge.session import through_table

ORDERS = (3, 4, 5)
SLOTS = 1 << 20
SAMPLE = 4000
# Features with the largest share of explained difference that the regression gets.
FEATURES = 3000
LEAST_TEXTS = 3
_GAP = 0x1FFFFF


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def gram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every n-gram of every text, and the text it belongs to; n-grams never cross texts."""
    lowered = [t.lower() for t in texts]
    widest = max(ORDERS)
    sizes = np.array([len(t) for t in lowered], np.int64)
    room = sizes + 2
    at = np.cumsum(room) - room
    letters = np.full(int(room.sum()) + widest, _GAP, np.uint64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters[np.arange(len(points)) + np.repeat(at + 1 - (np.cumsum(sizes) - sizes), sizes)] = points
    owner = np.repeat(np.arange(len(texts)), room)
    slots, owners = [], []
    n = len(owner)
    for order in ORDERS:
        value = np.full(n, order, np.uint64)
        inside = np.ones(n, bool)
        for k in range(order):
            value = value * np.uint64(0x9E3779B97F4A7C15) + letters[k:n + k]
            # a gap may stand at either end of an n-gram (the text's edge) but not within it
            if 0 < k < order - 1:
                inside &= letters[k:n + k] != _GAP
        inside[max(0, n - order + 1):] = False
        if order > 1:
            inside[:-1] &= owner[:-1] == owner[np.minimum(np.arange(n - 1) + order - 1, n - 1)]
        slots.append((mix(value[inside]) >> np.uint64(44)).astype(np.int64))
        owners.append(owner[inside])
    return np.concatenate(slots), np.concatenate(owners)


def distinct_slots(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each text (among the wanted ones), and their text, by text."""
    slots, owners = gram_slots(texts)
    if wanted is not None:
        keep = wanted[slots]
        slots, owners = slots[keep], owners[keep]
    pairs = np.unique(owners * SLOTS + slots)
    return pairs % SLOTS, pairs // SLOTS


def training_rows(labels: DataFrame, label: str, keep: Column, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels of the sample, at most ``sample`` per class, and the size of each class."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(keep & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("label") == c).orderBy(*by_hash).limit(sample) for c in (0, 1)]
    return picked[0].unionAll(picked[1]), sizes


def sample_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the sampled rows, kept as a table; the sampled ids are few and go to all tasks."""
    texts = documents_of(docs).join(F.broadcast(rows), "doc_id")
    return through_table(texts.select("doc_id", "label", "text"), "training-sample")


class Weights:
    """Intercept and weight of each slot."""

    def __init__(self, intercept: float, slots: np.ndarray, values: np.ndarray) -> None:
        self.intercept = intercept
        self.table = np.zeros(SLOTS, np.float32)
        self.table[slots] = values

    def score(self, texts: list[str]) -> np.ndarray:
        slots, owners = distinct_slots(texts, self.table != 0)
        z = self.intercept + np.bincount(owners, self.table[slots].astype(np.float64), len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _counts(sample: DataFrame) -> DataFrame:
    """``(slot, toxic, other)``: in how many texts of either class each slot occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for part_at, part in _with_places(batch):
                slots, owners = distinct_slots(part)
                for c in (0, 1):
                    found[c] += np.bincount(slots[labels[part_at + owners] == c], minlength=SLOTS)
        seen = np.flatnonzero(found.any(axis=0))
        if len(seen):
            for chunk in np.array_split(seen, 1 + len(seen) // 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk), pa.array(found[1][chunk]), pa.array(found[0][chunk])],
                    names=["slot", "toxic", "other"],
                )

    partial = sample.select("doc_id", "label", "text").mapInArrow(run, "slot long, toxic long, other long")
    return partial.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _with_places(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    at = 0
    for part in slices(batch):
        yield at, part.column(part.schema.get_field_index("text")).to_pylist()
        at += part.num_rows


def learn(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE) -> Weights:
    """Weights from the labelled rows for which ``keep`` (over ``doc_id``) holds."""
    none = np.zeros(0, np.int64), np.zeros(0)
    rows, sizes = training_rows(labels, "toxic", keep, sample)
    if len(sizes) < 2:
        share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
        return Weights(math.log((share + 1e-6) / (1 - share + 1e-6)), *none)
    table = sample_texts(docs, rows)
    own = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    if len(own) < 2:
        return Weights(math.log(sizes[1] / sizes[0]), *none)
    toxic, other = F.col("toxic"), F.col("other")
    ratio = F.log((toxic + 1) / F.lit(own[1] + 2)) - F.log((other + 1) / F.lit(own[0] + 2))
    weight = F.abs(toxic / F.lit(own[1]) - other / F.lit(own[0])) * F.abs(ratio)
    chosen = (
        _counts(table).where(toxic + other >= LEAST_TEXTS).select("slot", ratio.alias("ratio"), weight.alias("weight"))
        .orderBy(F.desc("weight"), "slot").limit(FEATURES).collect()  # at most FEATURES rows
    )
    if not chosen:
        return Weights(math.log(sizes[1] / sizes[0]), *none)
    slots = np.array(sorted(r["slot"] for r in chosen))
    by_slot = {r["slot"]: r["ratio"] for r in chosen}
    ratios = np.array([by_slot[s] for s in slots.tolist()])
    wanted = np.zeros(SLOTS, bool)
    wanted[slots] = True

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _with_places(batch):
                found, owners = distinct_slots(texts, wanted)
                places = np.searchsorted(slots, found).astype(np.int32)
                offsets = np.searchsorted(owners, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places))],
                    names=["label", "places"],
                )

    size = len(slots)
    to_vector = F.udf(lambda places: Vectors.sparse(size, places, ratios[places].tolist()), VectorUDT())
    # a few thousand rows
    rows = table.select("doc_id", "label", "text").mapInArrow(present, "label int, places array<int>")
    data = through_table(rows, "training-features").select("label", to_vector("places").alias("features")).cache()
    model = LogisticRegression(maxIter=60, regParam=0.0005, standardization=False).fit(data)
    data.unpersist()
    prior = math.log(sizes[1] / sizes[0]) - math.log(own[1] / own[0])
    return Weights(model.intercept + prior, slots, model.coefficients.toArray() * ratios)


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """``(doc_id, score)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(weights.score(part.column(1).to_pylist()))], names=["doc_id", "score"]
                )

    return documents_of(docs).mapInArrow(run, "doc_id long, score double")
