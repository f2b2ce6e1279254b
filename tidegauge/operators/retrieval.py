"""Chunking, embedding and hybrid retrieval over document tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.functions.text import (
    format_context,
    lexical_overlap,
    normalize_document,
    trim_block,
)
from tidegauge.functions.vectors import hybrid_score
from tidegauge.operators.ranking import top_per_key

# Retrieval defaults.
CHUNK_SIZE, CHUNK_OVERLAP = 900, 150
TOP_K, LEXICAL_WEIGHT, CANDIDATE_MULTIPLIER = 4, 0.15, 4
CHUNK_OVERHEAD_BYTES = 24
# Texts embedded at once, which bounds what a worker holds whatever the size of its batches.
EMBED_ROWS = 1_000

Encoder = Callable[[list[str]], np.ndarray]

# --- chunks -----------------------------------------------------------------


def _windows(paragraph: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of one paragraph, trimmed, blanks dropped."""
    starts = F.sequence(F.lit(0), F.length(paragraph) - 1, F.lit(max(1, size - overlap)))
    cuts = F.transform(starts, lambda s: trim_block(F.substr(paragraph, s + 1, F.lit(size))))
    return F.filter(cuts, lambda c: c != "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_texts(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of a normalised text as an array.

    Paragraphs are packed greedily up to ``size``; a longer one is cut into
    windows. Packing folds over the lengths of the paragraphs inside the JVM and
    notes where each chunk starts; the texts are then joined once. The overlap seed
    left by a flush never survives: the paragraph that caused the flush either
    starts afresh or is cut into windows.
    """
    paragraphs = F.filter(
        F.transform(F.split(text, "\n\n"), lambda p: trim_block(p)), lambda p: p != ""
    )

    def add(state: Column, paragraph: Column) -> Column:
        joined = state["open"] + 2 + paragraph["length"]
        begun = F.concat(state["starts"], F.array(paragraph["place"]))
        # nothing is open after a paragraph that is cut into windows
        length = F.when(paragraph["length"] <= size, paragraph["length"]).otherwise(F.lit(0))
        return F.when(
            (state["open"] > 0) & (joined <= size), F.struct(joined.alias("open"), state["starts"].alias("starts"))
        ).otherwise(F.struct(length.alias("open"), begun.alias("starts")))

    def starts_of(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p, k: F.struct(k.alias("place"), F.length(p).alias("length")))
        none = F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(lengths, none, add, lambda state: state["starts"])

    def cut(parts: Column, starts: Column) -> Column:
        def chunk(start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(parts))
            first = F.get(parts, start)
            joined = F.array(F.array_join(F.slice(parts, start + 1, stop - start), "\n\n"))
            return F.when(F.length(first) > size, _windows(first, size, overlap)).otherwise(joined)

        return F.flatten(F.transform(starts, chunk))

    return _bound(paragraphs, lambda parts: _bound(starts_of(parts), lambda starts: cut(parts, starts)))


def chunk_documents(
    documents: DataFrame,
    source: str = "source",
    text: str = "text",
    source_type: str | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    normalize: bool = True,
) -> DataFrame:
    """One row per chunk: source, source_type, chunk_id, text, char_count."""
    body = normalize_document(F.col(text)) if normalize else F.col(text)
    kind = F.col(source_type) if source_type else F.lit("markdown")
    prepared = documents.select(
        F.col(source).cast("string").alias("source"), kind.alias("source_type"), body.alias("_body")
    )
    pieces = prepared.select(
        "source", "source_type", F.posexplode(chunk_texts(F.col("_body"), size, overlap)).alias("chunk_id", "text")
    )
    return pieces.withColumn("char_count", F.length("text"))


def chunk_key() -> Column:
    """Sortable name of a chunk."""
    return F.concat_ws("#", "source", F.lpad(F.col("chunk_id").cast("string"), 8, "0"))


def index_statistics(chunks: DataFrame, documents: DataFrame, path: str, text: str, dimension: int) -> DataFrame:
    """Files, chunks and bytes of sources, chunks and four-byte vectors."""
    chunk_bytes = (
        F.octet_length("text") + F.octet_length("source") + F.octet_length("source_type")
        + F.lit(CHUNK_OVERHEAD_BYTES)
    )
    made = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(chunk_bytes), F.lit(0)).alias("chunk_bytes")
    )
    read = documents.agg(
        F.count_distinct(F.col(path)).alias("files"),
        F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("source_bytes"),
    )
    # two single rows side by side
    joined = made.withColumn("_one", F.lit(1)).join(read.withColumn("_one", F.lit(1)), "_one")
    return joined.select(
        "files", "chunks", "source_bytes", "chunk_bytes",
        (F.col("chunks") * dimension * 4).alias("embedding_bytes"),
        (F.col("chunk_bytes") + F.col("chunks") * dimension * 4).alias("estimated_bytes"),
    )


# --- embeddings -------------------------------------------------------------


@lru_cache(maxsize=1 << 18)
def _term_slot(term: str, dimension: int) -> int:
    return int(hashlib.md5(term.encode("utf-8")).hexdigest()[:8], 16) % dimension


def hashed_terms(dimension: int = 256) -> Encoder:
    """Encoder without a model: hashed counts of the lower-cased words."""

    def encode(texts: list[str]) -> np.ndarray:
        matrix = np.zeros((len(texts), dimension), dtype=np.float64)
        for row, text in enumerate(texts):
            for term in text.lower().split():
                matrix[row, _term_slot(term, dimension)] += 1.0
        return matrix

    return encode


def keyword_counts(keywords: list[str]) -> Encoder:
    """Encoder that counts given words, for fixtures."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[float(t.lower().count(k)) for k in keywords] for t in texts])

    return encode


def embed(text: Column, encoder: Encoder, normalize: bool = True) -> Column:
    """Vectors of a text column in Arrow batches, of length one unless told otherwise."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for start in range(0, max(1, len(batch)), EMBED_ROWS):
                yield pd.Series(list(_encoded(batch.iloc[start:start + EMBED_ROWS], encoder, normalize)))

    return run(text)


def _encoded(texts: pd.Series, encoder: Encoder, normalize: bool = True) -> np.ndarray:
    vectors = np.asarray(encoder([t or "" for t in texts]), dtype=np.float64)
    if normalize and len(vectors):
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(lengths == 0.0, 1e-12, lengths)
    return vectors


# --- nearest chunks ---------------------------------------------------------

# Scores are compared at this many decimals, so that equal passages tie however
# the matrix product was blocked, and the tie goes to the smaller key.
SCORE_DECIMALS = 9
BROADCAST_QUERY_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 20_000
# Cells of a score matrix: corpus rows are scored in slices so that it stays this small.
SCORE_CELLS = 2_000_000
BROADCAST_CANDIDATES = 200_000


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k greatest scores, equal ones by key; ``keys`` has the shape of ``scores``."""
    order = np.lexsort((keys, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)


def _scan(batches, queries: np.ndarray, k: int):
    """Best k corpus keys per query over batches of (keys, vectors); memory is queries x k."""
    best_scores = best_keys = None
    for keys, vectors in batches:
        if len(keys) == 0:
            continue
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        scores = np.round(queries @ vectors[order].T, SCORE_DECIMALS)
        if scores.shape[1] > k:
            # keys ascend, so a stable sort of the scores settles ties by key
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores = np.take_along_axis(scores, top, 1)
            found = keys[top]
        else:
            found = np.broadcast_to(keys, scores.shape)
        if best_scores is not None:
            scores = np.concatenate([best_scores, scores], axis=1)
            found = np.concatenate([best_keys, found], axis=1)
        best_scores, best_keys = _best(scores, found, k)
    return best_scores, best_keys


def _result(query_keys, scores, keys) -> pd.DataFrame:
    width = scores.shape[1]
    return pd.DataFrame(
        {"query": np.repeat(query_keys, width), "key": keys.ravel(), "score": scores.ravel()}
    )


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "key",
    vector: str = "vector",
    query: str = "query",
    query_vector: str = "vector",
    broadcast_bytes: int = BROADCAST_QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
    encoder: Encoder | None = None,
) -> DataFrame:
    """The k best corpus rows per query by dot product: ``(query, key, score, rank)``.

    With an ``encoder`` the corpus column holds texts, which are embedded in the
    same pass that scores them, so no vector crosses between JVM and Python.

    Every task keeps k rows per query and no pair leaves it. Queries whose counted
    size fits the bound go to all tasks; more of them are cut into blocks, as is
    the corpus, and each pair of blocks is one group of bounded size.
    """
    left = corpus.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    right = queries.select(F.col(query).alias("query"), F.col(query_vector).alias("vector"))
    size = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    n_queries, dimension = size["n"], size["d"] or 1
    kinds = {f.name: f.dataType for f in [left.schema["key"], right.schema["query"]]}
    schema = T.StructType(
        [
            T.StructField("query", kinds["query"]),
            T.StructField("key", kinds["key"]),
            T.StructField("score", T.DoubleType()),
        ]
    )

    if n_queries * (dimension + 4 * k) * 8 <= broadcast_bytes:
        rows = right.orderBy("query").collect()  # bounded by the check above
        names = np.array([r["query"] for r in rows])
        matrix = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), dimension)
        shared = corpus.sparkSession.sparkContext.broadcast((names, matrix))

        def vectors_of(column: pd.Series) -> np.ndarray:
            return np.stack(column).astype(np.float64) if encoder is None else _encoded(column, encoder)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_keys, query_matrix = shared.value
            if len(query_keys) == 0:
                return
            step = max(1, SCORE_CELLS // len(query_keys))
            pairs = (
                (part["key"].to_numpy(), vectors_of(part["vector"]))
                for b in batches
                for part in (b.iloc[i : i + step] for i in range(0, len(b), step))
            )
            scores, keys = _scan(pairs, query_matrix, k)
            if scores is not None:
                yield _result(query_keys, scores, keys)

        partial = left.mapInPandas(search, schema)
    else:
        if encoder is not None:
            left = left.withColumn("vector", embed(F.col("vector"), encoder))
        corpus_blocks = max(1, math.ceil(left.count() / block_rows))
        query_blocks = max(1, math.ceil(n_queries / block_rows))

        def blocked(df: DataFrame, own: str, name: str, count: int, other: str, others: int) -> DataFrame:
            block = F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
            copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
            return df.select(block.alias(own), copies.alias(other), "*")

        c = blocked(left, "cb", "key", corpus_blocks, "qb", query_blocks)
        q = blocked(right, "qb", "query", query_blocks, "cb", corpus_blocks)

        def search_block(chunk: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if len(chunk) == 0 or len(asked) == 0:
                return pd.DataFrame({"query": [], "key": [], "score": []})
            vectors = np.stack(chunk["vector"]).astype(np.float64)
            step = max(1, SCORE_CELLS // max(1, len(asked)))
            pairs = (
                (chunk["key"].to_numpy()[i : i + step], vectors[i : i + step])
                for i in range(0, len(chunk), step)
            )
            scores, keys = _scan(pairs, np.stack(asked["vector"]).astype(np.float64), k)
            return _result(asked["query"].to_numpy(), scores, keys)

        partial = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInPandas(search_block, schema)

    return top_per_key(partial, ["query"], [F.col("score").desc(), F.col("key")], k)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    encoder: Encoder,
    top_k: int = TOP_K,
    lexical_weight: float = LEXICAL_WEIGHT,
    multiplier: int = CANDIDATE_MULTIPLIER,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Ranked contexts per query row ``(query_id, text)``; blank queries give none.

    Vector search keeps ``top_k * multiplier`` candidates per query, which are
    then re-ranked with their word overlap. ``vectors`` holds stored chunk
    vectors ``(key, vector)``; without it chunks are embedded on the fly.
    """
    asked = queries.select("query_id", normalize_document(F.col("text")).alias("question"))
    asked = asked.where(F.col("question") != "")
    named = chunks.withColumn("key", chunk_key())
    candidates = max(top_k, top_k * multiplier)
    found = nearest(
        named if vectors is None else vectors,
        asked.select(F.col("query_id").alias("query"), embed(F.col("question"), encoder).alias("vector")),
        candidates,
        vector="text" if vectors is None else "vector",
        encoder=encoder if vectors is None else None,
    ).select(F.col("query").alias("query_id"), "key", F.col("score").alias("vector_score"))
    # every query keeps a fixed number of candidates, so their count is known
    if asked.count() * candidates <= BROADCAST_CANDIDATES:
        found = F.broadcast(found)
    candidates = named.join(found, "key").join(asked, "query_id")
    lexical = lexical_overlap(F.col("question"), F.col("text"))
    scored = candidates.withColumns({"lexical_score": lexical}).withColumn(
        "score",
        F.round(hybrid_score(F.col("vector_score"), F.col("lexical_score"), lexical_weight), SCORE_DECIMALS),
    )
    ranked = top_per_key(
        scored,
        ["query_id"],
        [F.col("score").desc(), F.col("vector_score").desc(), F.col("key")],
        top_k,
    )
    context = format_context(F.col("source"), F.col("source_type"), F.col("chunk_id"), F.col("text"))
    return ranked.select(
        "query_id", "rank", "source", "chunk_id", "vector_score", "lexical_score", "score",
        context.alias("context"),
    )
