"""Inverted-file index over vectors: lists around centroids, searched by nearness or to a certain end.

Centroids are fitted on a bounded sample; every vector is placed in the list of its nearest centroid.
A query visits the lists whose centroids have the greatest products with it. For a vector x in the list
of c, ``q.x <= q.c + |q| * r`` with r the greatest distance in the list, so that a list whose bound lies
below the k-th score found cannot add anything: :func:`search_exact` visits the lists that remain and
equals :func:`retrieval.nearest`.

Lists are cut into blocks of bounded size, as are the queries that visit a list, so that neither a list
that holds a third of all vectors nor one that all queries visit meets in one task.

Rows without a key or a vector are not in the index; equal vectors are all in it; ties go to the smaller
key. An empty table gives an index without lists, in which nothing is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.operators import retrieval
from tidegauge.operators.ranking import top_per_key
from tidegauge.session import through_table

# Bounds of the fit: vectors sampled (smallest hashes of their keys), and lists. Centroids go to all tasks.
SAMPLE_ROWS = 100_000
MOST_LISTS = 4096
ROWS_PER_LIST_SAMPLED = 24
# Bounds of one group of the search.
BLOCK_ROWS = 20_000
# Bounded sample of queries by which the number of lists to visit is chosen.
SAMPLE_QUERIES = 200
TARGET_RECALL = 0.95
# Scores are rounded to nine decimals before they are compared.
SLACK = 1e-8


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` hold ``(key, vector, list, block)``; ``lists`` one row per list in use."""

    rows: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    radii: np.ndarray


def list_count(rows: int) -> int:
    """Lists for so many vectors: the square root, as far as the sample can tell them apart."""
    return max(1, min(round(math.sqrt(rows)), MOST_LISTS, min(rows, SAMPLE_ROWS) // ROWS_PER_LIST_SAMPLED))


def fit_centroids(corpus: DataFrame, lists: int, sample: int = SAMPLE_ROWS, seed: int = 42) -> np.ndarray:
    """Centroids of at most ``sample`` vectors, those of the smallest key hashes."""
    chosen = corpus.orderBy(F.xxhash64("key"), "key").limit(sample).select(array_to_vector("vector").alias("features"))
    chosen = chosen.persist()
    try:
        if chosen.isEmpty():
            return np.zeros((0, 0))
        model = KMeans(k=max(2, lists), seed=seed, maxIter=10, initMode="random").fit(chosen)
        return np.array(model.clusterCenters())
    finally:
        chosen.unpersist()


def _place(centroids: np.ndarray, vector: Column) -> Column:
    """List of the nearest centroid, and the distance to it."""
    squares = (centroids * centroids).sum(axis=1)

    @F.pandas_udf("list int, away double")
    def run(vectors: pd.Series) -> pd.DataFrame:
        places, aways = [np.zeros(0, np.int32)], [np.zeros(0)]
        step = max(1, retrieval.SCORE_CELLS // len(centroids))
        for at in range(0, len(vectors), step):
            part = np.stack(vectors.iloc[at : at + step]).astype(np.float64)
            place = (squares - 2 * (part @ centroids.T)).argmin(axis=1)
            places.append(place.astype(np.int32))
            aways.append(np.linalg.norm(part - centroids[place], axis=1))
        return pd.DataFrame({"list": np.concatenate(places), "away": np.concatenate(aways)})

    return run(vector)


def build(
    corpus: DataFrame, key: str = "key", vector: str = "vector", lists: int | None = None,
    sample: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
) -> VectorIndex:
    """Fit centroids and place every vector; the placed rows are stored once."""
    rows = corpus.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("key").isNotNull() & F.col("vector").isNotNull())
    centroids = fit_centroids(rows, lists or list_count(rows.count()), sample)
    if len(centroids) == 0:
        none = rows.limit(0).withColumns({"list": F.lit(0), "block": F.lit(0)})
        empty = rows.sparkSession.createDataFrame([], "list int, n long, radius double, blocks int")
        return VectorIndex(none, empty, centroids, np.zeros(0))
    placed = rows.withColumn("_at", _place(centroids, F.col("vector")))
    stored = through_table(placed.select("key", "vector", "_at.list", "_at.away"), "vector-lists")
    found = stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    # one row per list, at most MOST_LISTS unless more are asked for
    radii = np.zeros(len(centroids))
    for r in found:
        radii[r["list"]] = r["radius"]
    described = rows.sparkSession.createDataFrame(
        [(r["list"], r["n"], r["radius"], math.ceil(r["n"] / block_rows)) for r in found],
        "list int, n long, radius double, blocks int",
    )
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    blocked = stored.join(F.broadcast(described.select("list", "blocks")), "list")
    return VectorIndex(blocked.select("key", "vector", "list", block), described, centroids, radii)


def _nearest_lists(index: VectorIndex, vector: Column, most: int) -> Column:
    """The lists of the greatest products with the query, best first."""
    centroids = index.centroids

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(vectors: pd.Series) -> pd.Series:
        scores = np.stack(vectors).astype(np.float64) @ centroids.T if len(vectors) else np.zeros((0, len(centroids)))
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :most].astype(np.int32)))

    return run(vector)


def _open_lists(index: VectorIndex, vector: Column, floor: Column, visited: int) -> Column:
    """The lists not among the first ``visited`` whose bound reaches ``floor`` (null: all)."""
    centroids, radii = index.centroids, index.radii

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(vectors: pd.Series, floors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        matrix = np.stack(vectors).astype(np.float64)
        scores = matrix @ centroids.T
        order = np.argsort(-scores, axis=1, kind="stable")
        bounds = scores + np.linalg.norm(matrix, axis=1, keepdims=True) * radii
        least = floors.astype(np.float64).fillna(-np.inf).to_numpy()
        found = []
        for row, (lists, bound) in enumerate(zip(order, bounds)):
            rest = lists[visited:]
            found.append(rest[bound[rest] >= least[row] - SLACK].astype(np.int32))
        return pd.Series(found)

    return run(vector, floor)


def _visit(index: VectorIndex, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The k best rows per query within the lists it names: ``(query, key, score)``.

    ``asked`` holds ``(query, vector, lists)``. Each block of a list meets each block of its queries.
    """
    visits = through_table(asked.select("query", "vector", F.explode("lists").alias("list")), "vector-visits")
    # one row per list
    sizes = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("groups"))
    plan = F.broadcast(index.lists.select("list", "blocks").join(sizes, "list"))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    corpus = index.rows.join(plan, "list").select("list", "block", every("groups").alias("group"), "key", "vector")
    own = F.pmod(F.xxhash64("query"), F.col("groups")).cast("int").alias("group")
    queries = visits.join(plan, "list").select("list", every("blocks").alias("block"), own, "query", "vector")

    schema = T.StructType([
        T.StructField("query", asked.schema["query"].dataType),
        T.StructField("key", index.rows.schema["key"].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def score(chunk: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if len(chunk) == 0 or len(wanted) == 0:
            return pd.DataFrame({"query": [], "key": [], "score": []})
        keys, vectors = chunk["key"].to_numpy(), np.stack(chunk["vector"]).astype(np.float64)
        step = max(1, retrieval.SCORE_CELLS // len(wanted))
        parts = ((keys[at : at + step], vectors[at : at + step]) for at in range(0, len(keys), step))
        scores, found = retrieval._scan(parts, np.stack(wanted["vector"]).astype(np.float64), k)
        return retrieval._result(wanted["query"].to_numpy(), scores, found)

    names = ["list", "block", "group"]
    return corpus.groupBy(*names).cogroup(queries.groupBy(*names)).applyInPandas(score, schema)


def _asked(index: VectorIndex, queries: DataFrame, query: str, vector: str) -> DataFrame:
    rows = queries.select(F.col(query).alias("query"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("query").isNotNull() & F.col("vector").isNotNull())
    return rows if len(index.centroids) else rows.limit(0)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_per_key(found, ["query"], [F.col("score").desc(), F.col("key")], k)


def search(
    index: VectorIndex, queries: DataFrame, k: int, visited: int, query: str = "query", vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k best rows of the ``visited`` nearest lists per query: ``(query, key, score, rank)``.

    Query names are unique. What other lists hold is not seen; see :func:`lists_to_visit` and :func:`recall`.
    """
    asked = _asked(index, queries, query, vector)
    if len(index.centroids):
        asked = asked.withColumn("lists", _nearest_lists(index, F.col("vector"), visited))
    else:
        asked = asked.withColumn("lists", F.array().cast("array<int>"))
    return _ranked(_visit(index, asked, k, block_rows), k)


def search_exact(
    index: VectorIndex, queries: DataFrame, k: int, visited: int, query: str = "query", vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k best rows of the whole index per query, as :func:`retrieval.nearest` gives them.

    After the nearest lists those are visited whose bound reaches the k-th score found so far.
    """
    if not len(index.centroids):
        return search(index, queries, k, visited, query, vector, block_rows)
    first = through_table(search(index, queries, k, visited, query, vector, block_rows), "vector-first")
    floors = first.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    asked = _asked(index, queries, query, vector).join(floors, "query", "left")
    asked = asked.withColumn("lists", _open_lists(index, F.col("vector"), F.col("floor"), visited))
    second = _visit(index, asked, k, block_rows)
    return _ranked(first.select("query", "key", "score").unionByName(second), k)


def lists_to_visit(
    index: VectorIndex, queries: DataFrame, k: int, target: float = TARGET_RECALL, sample: int = SAMPLE_QUERIES,
    query: str = "query", vector: str = "vector",
) -> int:
    """How many lists hold ``target`` of the true k best rows of a bounded sample of queries."""
    asked = _asked(index, queries, query, vector).orderBy(F.xxhash64("query"), "query").limit(sample)
    if not len(index.centroids) or asked.isEmpty():
        return 1
    asked = through_table(asked, "vector-sample")
    exact = retrieval.nearest(index.rows, asked, k)
    # at most sample * k rows
    homes = index.rows.select("key", "list").join(F.broadcast(exact.select("query", "key")), "key")
    order = asked.select("query", _nearest_lists(index, F.col("vector"), len(index.centroids)).alias("lists"))
    ranks = homes.join(order, "query").select(F.array_position("lists", F.col("list")).alias("rank"))
    return int(math.ceil(ranks.agg(F.percentile("rank", F.lit(target))).first()[0]))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, rows that should be found, rows that were, and their share."""
    hits = found.select("query", "key", F.lit(1).alias("hit"))
    joined = exact.select("query", "key").join(hits, ["query", "key"], "left")
    counted = joined.agg(
        F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")
    )
    return counted.withColumn("recall", F.col("found") / F.greatest(F.col("wanted"), F.lit(1)))
