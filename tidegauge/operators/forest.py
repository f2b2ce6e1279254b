"""Random forest for a 0/1 label over binned features, with the split rule and defaults of Spark's own.

Spark's forest sums up every node of every level over all rows, so that the sums it moves grow with nodes times tasks:
a forest of hundreds of deep trees has millions of nodes. Here the upper levels of many trees are grown from such sums,
a job a level for all of them; a node of at most ``LOCAL_ROWS`` rows is set aside and finished in one task that gets its
rows, which are moved once. As many trees are grown together as keep those rows below ``MOVED_BYTES``.

Each tree draws its rows with replacement. Equal rows are numbered and drawn one by one. Draws depend on the row's
contents, its number and the seed, and sums are whole numbers, so a model never depends on how rows are spread. A null or
NaN is less than every number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import boosting
from tidegauge.session import shared_folder, through_table

# Rows of a node that one task finishes; bytes of rows moved to such tasks at a time; nodes of a level split at once.
LOCAL_ROWS = 500_000
MOVED_BYTES = 2 << 30
NODES_AT_ONCE = 256
_COPIES_AT_ONCE = 10_000
# Quantiles between which a feature is cut; Spark's forest has 32.
QUANTILES = 125
# Chances of being drawn 0, 1, 2, ... times or less out of as many draws as there are rows.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass(frozen=True)
class Growth:
    """How the trees of one forest are grown. ``weights`` and ``positive`` are by code of a row's label and weight; a tree
    that draws no row says ``prior``."""

    depth: int
    least_leaf_rows: int
    split_features: int
    bootstrap: bool
    seed: int
    n_features: int
    n_bins: int
    weights: np.ndarray
    positive: np.ndarray
    prior: float


@dataclass
class Rows:
    """Rows of a task: bins by row and feature, code, and key of the draws (in a block) or times drawn (in a node)."""

    bins: np.ndarray
    code: np.ndarray
    drawn: np.ndarray


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Bins up to ``cut`` go left. ``share`` is that of the label 1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    gain: np.ndarray

    @staticmethod
    def leaves(shares: np.ndarray, gains: int) -> "Tree":
        n = len(shares)
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.int32),
                    shares.astype(np.float32), np.zeros(gains))

    def extended(self, more: "Tree") -> "Tree":
        joined = (np.concatenate([getattr(self, c), getattr(more, c)]) for c in ("feature", "cut", "left", "right", "share"))
        return Tree(*joined, self.gain + more.gain)

    def grafted(self, below: dict[int, "Tree"]) -> "Tree":
        """With trees grown elsewhere in the places of leaves."""
        whole = [self]
        size = len(self.feature)
        for node, tree in sorted(below.items()):
            shift = size - 1
            for column in ("feature", "cut", "share"):
                getattr(self, column)[node] = getattr(tree, column)[0]
            left, right = (np.where(tree.feature >= 0, x + shift, 0).astype(np.int32) for x in (tree.left, tree.right))
            self.left[node], self.right[node] = left[0], right[0]
            whole.append(Tree(tree.feature[1:], tree.cut[1:], left[1:], right[1:], tree.share[1:], tree.gain))
            size += len(tree.feature) - 1
        columns = ([getattr(t, c) for t in whole] for c in ("feature", "cut", "left", "right", "share"))
        return Tree(*(np.concatenate(c) for c in columns), sum(t.gain for t in whole))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; bins by row and feature."""
        width, flat = bins.shape[1], bins.ravel()
        at = np.zeros(len(bins), np.int32)
        rows = np.arange(len(bins))
        while True:
            feature = self.feature.take(at.take(rows))
            rows = rows[feature >= 0]
            if not len(rows):
                return at
            node = at.take(rows)
            low = flat.take(rows * width + self.feature.take(node)) <= self.cut.take(node)
            at[rows] = np.where(low, self.left.take(node), self.right.take(node))


def _times(keys: np.ndarray, growth: Growth, number: int) -> np.ndarray:
    """How often each row is drawn for one tree."""
    if not growth.bootstrap:
        return np.ones(len(keys), np.uint8)
    return np.searchsorted(_DRAWN, boosting._draws(keys, growth.seed, number), side="right").astype(np.uint8)


def _chosen(growth: Growth, number: int, paths: np.ndarray) -> np.ndarray:
    """The features that each node may be split on, by node; the root's path is 1, the children of k are 2 k and 2 k + 1."""
    n, count = growth.n_features, growth.split_features
    if count >= n:
        return np.tile(np.arange(n), (len(paths), 1))
    keys = paths.astype(np.uint64)[:, None] * np.uint64(n) + np.arange(n, dtype=np.uint64)
    return np.sort(np.argsort(boosting._draws(keys, growth.seed + 1, number), axis=1)[:, :count], axis=1)


def _sums(rows: Rows, index: np.ndarray, slot: np.ndarray, drawn: np.ndarray, code: np.ndarray, chosen: np.ndarray, growth: Growth) -> np.ndarray:
    """Times drawn by slot, code, chosen feature and bin."""
    codes, (slots, count) = len(growth.weights), chosen.shape
    width, flat = rows.bins.shape[1], rows.bins.ravel()
    place, cell = index * width, (slot * codes + code) * growth.n_bins
    out = np.empty((slots, codes, count, growth.n_bins))
    for k in range(count):
        own = cell + flat.take(place + chosen[:, k].take(slot))
        out[:, :, k] = np.bincount(own, drawn, slots * codes * growth.n_bins).reshape(slots, codes, growth.n_bins)
    return out


def _impurity(positive: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Half the Gini impurity times weight."""
    out = weight - positive
    out *= positive
    return np.divide(out, weight, out=out, where=weight > 0)  # 0 without weight


def best_splits(sums: np.ndarray, chosen: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted gain (0: no split), feature and last bin on the left of each node; the first one on ties."""
    upto = np.cumsum(sums, axis=3)
    whole, left = upto[:, :, :1, -1:], upto[..., :-1]

    def totals(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, weight and weight of the label 1."""
        rows, weight, positive = of[:, 0].copy(), of[:, 0] * growth.weights[0], of[:, 0] * (growth.weights[0] * growth.positive[0])
        for c in range(1, len(growth.weights)):
            more = of[:, c] * growth.weights[c]
            rows += of[:, c]
            weight += more
            if growth.positive[c]:
                positive += more
        return rows, weight, positive

    rows, weight, positive = totals(whole)
    left_rows, left_weight, left_positive = totals(left)
    gain = _impurity(positive, weight) - _impurity(left_positive, left_weight)
    gain -= _impurity(positive - left_positive, weight - left_weight)
    gain *= 2.0
    least = max(1, growth.least_leaf_rows)
    gain[(left_rows < least) | (left_rows > rows - least) | (gain <= 1e-12 * weight)] = 0.0
    gain = gain.reshape(len(gain), -1)
    at = gain.argmax(axis=1)
    nodes, bins = np.arange(len(gain)), growth.n_bins - 1
    return gain[nodes, at], chosen[nodes, at // bins], at % bins


def _shares(totals: np.ndarray, growth: Growth) -> np.ndarray:
    """Share of the label 1 in nodes, from times drawn by code."""
    weight = totals @ growth.weights
    return totals @ (growth.weights * growth.positive) / np.where(weight > 0, weight, 1.0)


def _may_split(totals: np.ndarray, growth: Growth, depth: int) -> np.ndarray:
    if depth >= growth.depth:
        return np.zeros(len(totals), bool)
    ones = totals[:, growth.positive > 0].sum(axis=1)
    rows = totals.sum(axis=1)
    return (rows >= 2 * max(1, growth.least_leaf_rows)) & (ones > 0) & (ones < rows)


def grow_here(rows: Rows, growth: Growth, number: int, path: int) -> Tree:
    """A tree of the given rows, from the node with that path on, level by level.

    The rows of a level lie in the order of their nodes: left children come before right ones.
    """
    codes, width, flat = len(growth.weights), rows.bins.shape[1], rows.bins.ravel()
    index, slot, paths = np.arange(len(rows.code)), np.zeros(len(rows.code), np.intp), np.array([path])
    code, drawn = rows.code.astype(np.intp), rows.drawn.astype(float)
    levels: list[Tree] = []
    made, depth = 0, path.bit_length() - 1
    while len(paths):
        totals = np.bincount(slot * codes + code, drawn, len(paths) * codes).reshape(-1, codes)
        level = Tree.leaves(_shares(totals, growth), growth.n_features)
        levels.append(level)
        made += len(paths)
        open_ = np.flatnonzero(_may_split(totals, growth, depth))
        if not len(open_):
            break
        number_of = np.full(len(paths), -1)
        number_of[open_] = np.arange(len(open_))
        slot = number_of.take(slot)
        kept = np.flatnonzero(slot >= 0)
        index, slot, code, drawn = index.take(kept), slot.take(kept), code.take(kept), drawn.take(kept)
        chosen = _chosen(growth, number, paths[open_])
        starts = range(0, len(open_), NODES_AT_ONCE)
        bounds = [*np.searchsorted(slot, starts), len(slot)]
        found = []
        for first, low, high in zip(starts, bounds, bounds[1:]):
            own, part = chosen[first:first + NODES_AT_ONCE], slice(low, high)
            found.append(best_splits(_sums(rows, index[part], slot[part] - first, drawn[part], code[part], own, growth), own, growth))
        gain, feature, cut = (np.concatenate(x) for x in zip(*found))
        split = np.flatnonzero(gain > 0)
        at, n = open_[split], len(split)
        level.feature[at], level.cut[at] = feature[split], cut[split]
        level.left[at], level.right[at] = made + np.arange(n), made + n + np.arange(n)
        level.gain += np.bincount(feature[split], gain[split], growth.n_features)
        rank = np.full(len(open_), -1)
        rank[split] = np.arange(n)
        low = flat.take(index * width + feature.take(slot)) <= cut.take(slot)
        below = rank.take(slot)
        lefts, rights = np.flatnonzero(low & (below >= 0)), np.flatnonzero(~low & (below >= 0))
        order = np.concatenate([lefts, rights])
        index, code, drawn = index.take(order), code.take(order), drawn.take(order)
        slot = np.concatenate([below.take(lefts), n + below.take(rights)])
        paths = np.concatenate([2 * paths[at], 2 * paths[at] + 1])
        depth += 1
    columns = (np.concatenate([getattr(t, c) for t in levels]) for c in ("feature", "cut", "left", "right", "share"))
    return Tree(*columns, sum(t.gain for t in levels))


class _Top:
    """The upper levels of one tree while they are grown: its nodes, their paths and those to be split next."""

    def __init__(self, growth: Growth, whole: bool) -> None:
        self.tree = Tree.leaves(np.array([growth.prior]), growth.n_features)
        self.paths = [1]
        self.open: list[int] = [] if whole else [0]
        self.aside: dict[int, float] = {0: 0.0} if whole else {}  # node: rows

    def advance(self, sums: np.ndarray, chosen: np.ndarray, growth: Growth) -> None:
        """Split the open nodes by their sums; children go aside when their rows are few."""
        if self.open == [0] and sums.any():
            self.tree.share[0] = _shares(sums[:, :, 0].sum(axis=2), growth)[0]
        following = []
        for node, own, features, gain, feature, cut in zip(self.open, sums, chosen, *best_splits(sums, chosen, growth)):
            if gain <= 0:
                continue
            cells = own[:, list(features).index(feature)]
            totals = np.stack([cells[:, :cut + 1].sum(axis=1), cells[:, cut + 1:].sum(axis=1)])
            first = len(self.paths)
            tree = self.tree = self.tree.extended(Tree.leaves(_shares(totals, growth), growth.n_features))
            tree.feature[node], tree.cut[node], tree.left[node], tree.right[node] = feature, cut, first, first + 1
            tree.gain[feature] += gain
            self.paths += [2 * self.paths[node], 2 * self.paths[node] + 1]
            ready = _may_split(totals, growth, self.paths[first].bit_length() - 1)
            for child, rows, may in zip((first, first + 1), totals.sum(axis=1), ready):
                if may and rows <= LOCAL_ROWS:
                    self.aside[child] = float(rows)
                elif may:
                    following.append(child)
        self.open = following


def _grow_trees(blocks: RDD, n_blocks: int, n_rows: int, growth: Growth, numbers: range, cores: int) -> list[Tree]:
    """Trees with these numbers."""
    tops = {number: _Top(growth, n_rows <= LOCAL_ROWS) for number in numbers}
    while any(top.open for top in tops.values()):
        work = [(number, top.tree, top.open, _chosen(growth, number, np.array(top.paths)[top.open]))
                for number, top in tops.items() if top.open]

        def sums(block: Rows) -> np.ndarray:
            parts = []
            for number, tree, nodes, chosen in work:
                slots = np.full(len(tree.feature), -1)
                slots[nodes] = np.arange(len(nodes))
                times = _times(block.drawn, growth, number)
                slot = slots.take(tree.place(block.bins))
                rows = np.flatnonzero((slot >= 0) & (times > 0))
                parts.append(_sums(block, rows, slot.take(rows), times.take(rows).astype(float), block.code.take(rows), chosen, growth))
            return np.concatenate(parts)

        cells = sum(len(nodes) for _, _, nodes, _ in work) * growth.split_features * growth.n_bins * len(growth.weights)
        total = blocks.map(sums).treeReduce(np.add, 1 if n_blocks * cells * 8 <= boosting._ADDED_BYTES else 2)
        for number, _, nodes, chosen in work:
            tops[number].advance(total[:len(nodes)], chosen, growth)
            total = total[len(nodes):]

    aside = {(number, node): rows for number, top in tops.items() for node, rows in top.aside.items()}
    if aside:
        # the nodes of most rows are dealt out first, each to the next task
        parts = min(len(aside), 4 * cores)
        task = {key: k % parts for k, key in enumerate(sorted(aside, key=lambda x: (-aside[x], x)))}
        paths = {(number, node): tops[number].paths[node] for number, node in aside}
        work = [(number, top.tree, list(top.aside)) for number, top in tops.items() if top.aside]

        def rows_of(block: Rows) -> Iterator[tuple[tuple[int, int], Rows]]:
            for number, tree, nodes in work:
                slots = np.full(len(tree.feature), -1)
                slots[nodes] = np.arange(len(nodes))
                times = _times(block.drawn, growth, number)
                slot = np.where(times > 0, slots.take(tree.place(block.bins)), -1)
                for k, node in enumerate(nodes):
                    own = np.flatnonzero(slot == k)
                    if len(own):
                        yield (number, node), Rows(block.bins.take(own, axis=0), block.code.take(own), times.take(own))

        def finish(items: Iterator[tuple[tuple[int, int], Rows]]) -> Iterator[tuple[tuple[int, int], Tree]]:
            by_node: dict[tuple[int, int], list[Rows]] = {}
            for key, rows in items:
                by_node.setdefault(key, []).append(rows)
            for key in list(by_node):
                own = by_node.pop(key)  # at most LOCAL_ROWS rows, each once
                joined = Rows(*(np.concatenate([getattr(r, c) for r in own]) for c in ("bins", "code", "drawn")))
                yield key, grow_here(joined, growth, key[0], paths[key])

        below: dict[int, dict[int, Tree]] = {}
        for (number, node), tree in blocks.flatMap(rows_of).partitionBy(parts, task.__getitem__).mapPartitions(finish).collect():
            below.setdefault(number, {})[node] = tree
        return [top.tree.grafted(below.get(number, {})) for number, top in tops.items()]
    return [top.tree for top in tops.values()]


def _blocks(rows: DataFrame, edges: list[np.ndarray], codes: pd.DataFrame, parts: int) -> RDD:
    """Blocks of binned rows, one a partition."""
    n = len(edges)
    code_of = {(y, w): k for k, (y, w) in enumerate(zip(codes["_y"], codes["_w"]))}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.ascontiguousarray(boosting.to_bins(boosting._matrix(batch.column(0), n), edges).T)
                label, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                code = np.zeros(batch.num_rows, np.uint8)
                for (y, w), k in code_of.items():
                    code[(label == y) & (weight == w)] = k
                keys = batch.column(3).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, code, keys)],
                                                 names=["bins", "code", "keys"])

    packed = rows.repartition(parts).mapInArrow(pack, "bins binary, code binary, keys binary")

    def join(items: Iterator) -> Iterator[Rows]:
        held = list(items)
        if held:
            bins, code, keys = (np.concatenate([np.frombuffer(r[c], kind) for r in held])
                                for c, kind in (("bins", np.uint8), ("code", np.uint8), ("keys", np.int64)))
            yield Rows(bins.reshape(-1, n), code, keys.view(np.uint64))

    return packed.rdd.mapPartitions(join)


class Forest(Estimator):
    """Estimator over a vector column, with the parameters and defaults of Spark's forest; learns a :class:`ForestModel`."""

    def __init__(
        self, featuresCol: str, labelCol: str, weightCol: str | None = None, numTrees: int = 20, maxDepth: int = 5,
        minInstancesPerNode: int = 1, featureSubsetStrategy: str = "auto", bootstrap: bool = True, seed: int = 0,
    ) -> None:
        super().__init__()
        self.columns = (featuresCol, labelCol, weightCol)
        self.trees, self.depth, self.least, self.subset = numTrees, maxDepth, minInstancesPerNode, featureSubsetStrategy
        self.bootstrap, self.seed = bootstrap, seed

    def getNumTrees(self) -> int:
        return self.trees

    def getMaxDepth(self) -> int:
        return self.depth

    def getMinInstancesPerNode(self) -> int:
        return self.least

    def getFeatureSubsetStrategy(self) -> str:
        return self.subset

    def _features_per_split(self, features: int) -> int:
        if self.subset == "all" or (self.subset == "auto" and self.trees == 1):
            return features
        return math.ceil(math.sqrt(features)) if self.subset == "auto" else min(int(self.subset), features)

    def _fit(self, dataset: DataFrame) -> "ForestModel":
        features, label, weight = self.columns
        spark = dataset.sparkSession
        shared_folder(spark)
        x = vector_to_array(features)
        counted = dataset.select(
            x.alias("_x"), F.col(label).cast("double").alias("_y"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
        ).groupBy("_x", "_y", "_w").agg(F.count(F.lit(1)).alias("_n"))
        # the copies of a row, listed so many at a time
        shares = counted.withColumn("_c", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {_COPIES_AT_ONCE}"))))
        last = F.least(F.col("_n"), (F.col("_c") + 1) * _COPIES_AT_ONCE) - 1
        copies = shares.withColumn("_copy", F.explode(F.sequence(F.col("_c") * _COPIES_AT_ONCE, last)))
        rows = through_table(copies.select("_x", "_y", "_w", F.xxhash64("_x", "_y", "_copy").alias("_k")), "forest-rows")
        codes = rows.groupBy("_y", "_w").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("f")).orderBy("_y", "_w").limit(257).toPandas()
        if not len(codes):
            raise ValueError("no rows to learn from")
        if not codes["_y"].isin([0.0, 1.0]).all():
            raise ValueError("labels other than 0 and 1")
        if len(codes) > 256:
            raise ValueError("more than 256 pairs of label and weight")
        n_rows, n = int(codes["n"].sum()), int(codes["f"].max())
        edges = boosting.bin_edges(rows, n, QUANTILES + 2, QUANTILES)
        growth = Growth(
            self.depth, self.least, self._features_per_split(n), self.bootstrap and self.trees > 1, self.seed, n,
            max(len(e) for e in edges) + 1, codes["_w"].to_numpy(float), codes["_y"].to_numpy(float),
            float((codes["n"] * codes["_w"] * codes["_y"]).sum() / (codes["n"] * codes["_w"]).sum()),
        )
        cores = spark.sparkContext.defaultParallelism
        parts = max(math.ceil(n_rows * (n + 9) / boosting.BLOCK_BYTES), min(cores, math.ceil(n_rows / boosting.BLOCK_ROWS)))
        blocks = _blocks(rows, edges, codes, parts).persist(StorageLevel.MEMORY_AND_DISK)
        at_once = max(1, MOVED_BYTES // (n_rows * (n + 2)))
        trees: list[Tree] = []
        for first in range(0, self.trees, at_once):
            trees += _grow_trees(blocks, parts, n_rows, growth, range(first, min(first + at_once, self.trees)), cores)
        blocks.unpersist()
        return ForestModel(features)._learned(trees, edges)


class ForestModel(Model, MLReadable, MLWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)

    def __init__(self, featuresCol: str = "features") -> None:
        super().__init__()
        self._set(featuresCol=featuresCol)
        self.trees: list[Tree] = []
        self.edges: list[np.ndarray] = []

    def _learned(self, trees: list[Tree], edges: list[np.ndarray]) -> "ForestModel":
        self.trees, self.edges = trees, edges
        return self

    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of a tree's gains, as a mean over trees."""
        total = sum((t.gain / t.gain.sum() if t.gain.sum() else t.gain) for t in self.trees)
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned = dataset.sparkSession.sparkContext.broadcast((self.trees, self.edges))

        @F.pandas_udf("double")
        def share(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            trees, edges = learned.value
            bins = np.ascontiguousarray(boosting.to_bins(np.stack(vectors.to_numpy()), edges).T)
            out = np.zeros(len(bins))
            for tree in trees:
                out += tree.share.take(tree.place(bins))
            return pd.Series(out / len(trees))

        p = F.col("_share")
        scored = dataset.withColumn("_share", share(vector_to_array(self.getOrDefault(self.featuresCol))))
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector(F.array((1.0 - p) * len(self.trees), p * len(self.trees))),
                "probability": array_to_vector(F.array(1.0 - p, p)),
                "prediction": (p > 0.5).cast("double"),
            }
        ).drop("_share")

    def write(self) -> "_ForestWriter":
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> "_ForestReader":
        return _ForestReader(cls)


_TREE_LAYOUT = ("number int, feature array<smallint>, cut array<smallint>, `left` array<int>, `right` array<int>, "
                "share array<float>, gain array<double>")


class _ForestWriter(DefaultParamsWriter):
    """Parameters and thresholds as metadata, and a table of trees."""

    def saveImpl(self, path: str) -> None:
        model, spark = self.instance, self.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark, {"edges": [e.tolist() for e in model.edges]})
        _tree_table(spark, model.trees).write.parquet(f"{path}/trees")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        kinds = (np.int16, np.uint8, np.int32, np.int32, np.float32, float)
        found = self.sparkSession.read.schema(_TREE_LAYOUT).parquet(f"{path}/trees").orderBy("number").toLocalIterator()
        trees = [Tree(*(np.array(x, kind) for x, kind in zip(tuple(r)[1:], kinds))) for r in found]
        return model._learned(trees, [np.array(e, float) for e in metadata["edges"]])


def _tree_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    def row(number: int, t: Tree) -> tuple:
        return (number, *(getattr(t, c).tolist() for c in ("feature", "cut", "left", "right", "share", "gain")))

    numbered = spark.sparkContext.parallelize(list(enumerate(trees)), max(1, min(len(trees), 32)))
    return spark.createDataFrame(numbered.map(lambda x: row(*x)), _TREE_LAYOUT)
