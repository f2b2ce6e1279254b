"""Boosted trees for a 0/1 label by Newton steps over binned features.

Features are cut into at most ``max_bin`` bins at quantiles. A tree is grown level by level from one sum of
gradients and Hessians per node, feature and bin over all rows. Nodes whose rows are fewer bytes than their sums
are set aside, and so are nodes of few rows in a table that is moved sooner than jobs are started. They are finished
each in one task that gets their rows, in one job for all of them, where that spares several levels; a node is split the same way in either. Rows are kept as cached blocks, as many as there are cores once
rows are many, with their margins, which are brought forward by each
tree and checkpointed every so many trees, so a lost executor costs those since then.

Draws depend on the row's contents and the seed, never on how rows are spread. A null or NaN is less than every number.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tidegauge.session import shared_folder, through_table

# A node of at most so many rows is finished in one task; rows that are worth a block of their own, and bytes of a
# block; trees between checkpoints; levels that setting a node aside has to spare.
LOCAL_ROWS = 200_000
BLOCK_ROWS = 20_000
BLOCK_BYTES = 64 << 20
CHECKPOINT_TREES = 40
SPARED_LEVELS = 4
# Rows that are moved in less time than the jobs of ``SPARED_LEVELS`` levels take to start.
MOVED_ROWS = 1_000_000
# Rows of a block that are summed up at a time: what is worked out for them stays in a core's cache.
_CHUNK_ROWS = 65_536
# Bytes of sums that the driver adds up itself; more are added in tasks first.
_ADDED_BYTES = 32 << 20
# Up to so many splits, rows are placed split by split instead of row by row.
_MASKED_SPLITS = 40
# What is summed up per node, feature and bin.
_GRADIENT, _HESSIAN, _ROWS, _WEIGHT = range(4)


@dataclass(frozen=True)
class Rules:
    """How trees are grown. ``newton`` weighs splits by Hessians, else by row weights (leaves always use Hessians)."""

    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    newton: bool = True
    l2: float = 1.0
    l1: float = 0.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    least_leaf_rows: int = 1
    least_split_rows: int = 2
    row_share: float = 1.0
    tree_features: float = 1.0
    split_features: int | None = None
    max_bin: int = 256
    base_score: float | None = None
    seed: int = 0


def _soft(total: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0)


def _worth(total: np.ndarray, size: np.ndarray, rules: Rules) -> np.ndarray:
    """Quality of a node by its sum of gradients and of Hessians or weights."""
    return np.divide(_soft(total, rules.l1) ** 2, size + rules.l2, out=np.zeros_like(total), where=size + rules.l2 > 0)


def leaf_value(sums: np.ndarray, rules: Rules) -> float:
    weight = sums[_HESSIAN] + rules.l2
    return float(-rules.rate * _soft(sums[_GRADIENT], rules.l1) / weight) if weight > 1e-12 else 0.0


def best_split(sums: np.ndarray, features: np.ndarray, rules: Rules) -> tuple[float, int, int] | None:
    """``(gain, feature, last bin on the left)`` of a node from its sums by feature, bin and kind; the first one on ties."""
    whole = sums[0].sum(axis=0)
    if whole[_ROWS] < rules.least_split_rows:
        return None
    left = np.cumsum(sums[features], axis=1)[:, :-1]
    right = whole - left
    size = _HESSIAN if rules.newton else _WEIGHT
    gain = (
        _worth(left[..., _GRADIENT], left[..., size], rules) + _worth(right[..., _GRADIENT], right[..., size], rules)
        - _worth(whole[_GRADIENT:_GRADIENT + 1], whole[size:size + 1], rules)
    )
    for side in (left, right):
        gain[side[..., _ROWS] < max(1, rules.least_leaf_rows)] = -np.inf
        gain[side[..., _HESSIAN] < rules.least_hessian] = -np.inf
    if not gain.size:
        return None
    at = int(np.argmax(gain))
    best = float(gain.flat[at])
    if not np.isfinite(best) or best <= 1e-9 or best < rules.least_gain:
        return None
    return best, int(features[at // gain.shape[1]]), at % gain.shape[1]


class Tree:
    """Nodes as lists; a leaf has feature -1. Bins up to ``cut`` go left."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value, self.gain = [-1], [0], [0], [0], [0.0], [0.0]
        self.path = [1]  # the root is 1, the children of k are 2 k and 2 k + 1

    def add(self, path: int, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value),
                          (self.gain, 0.0), (self.path, path)):
            column.append(x)
        return len(self.feature) - 1

    def split(self, node: int, found: tuple[float, int, int], values: tuple[float, float]) -> tuple[int, int]:
        self.gain[node], self.feature[node], self.cut[node] = found
        self.left[node] = self.add(2 * self.path[node], values[0])
        self.right[node] = self.add(2 * self.path[node] + 1, values[1])
        return self.left[node], self.right[node]

    def graft(self, node: int, below: "Tree") -> None:
        """Put a tree grown elsewhere in the place of a leaf."""
        shift = len(self.feature) - 1
        move = lambda k: node if k == 0 else k + shift
        for column in ("feature", "cut", "value", "gain"):
            own, new = getattr(self, column), getattr(below, column)
            own[node] = new[0]
            own += new[1:]
        for column in ("left", "right"):
            own, new = getattr(self, column), [move(k) for k in getattr(below, column)]
            own[node] = new[0]
            own += new[1:]
        self.path += below.path[1:]

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; bins by feature and row."""
        splits = [k for k, f in enumerate(self.feature) if f >= 0]
        if len(splits) <= _MASKED_SPLITS:
            at = np.zeros(bins.shape[1], np.int16)
            for k in splits:  # a node comes before its children
                here, low = at == k, bins[self.feature[k]] <= self.cut[k]
                np.copyto(at, self.left[k], where=here & low, casting="unsafe")
                np.copyto(at, self.right[k], where=here & ~low, casting="unsafe")
            return at
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(bins.shape[1], np.int64)
        rows = np.arange(bins.shape[1])
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            node = at[rows]
            low = bins[feature[node], rows] <= cut[node]
            at[rows] = np.where(low, left[node], right[node])
        return at


def histogram(bins: np.ndarray, slot: np.ndarray, kinds: np.ndarray, n_slots: int, n_bins: int) -> np.ndarray:
    """Sums by slot, feature, bin and kind over the sampled rows with a slot of 0 or more."""
    # the other rows go to a slot that is cut off, which is cheaper than to leave them out feature by feature
    base = np.where((slot >= 0) & (kinds[_ROWS] > 0), slot, n_slots) * n_bins
    plain = np.array_equal(kinds[_WEIGHT], kinds[_ROWS])
    size = (n_slots + 1) * n_bins
    out = np.empty((n_slots, len(bins), n_bins, len(kinds)))
    for f, own in enumerate(bins):
        key = base + own
        for k, values in enumerate(kinds):
            if k == _WEIGHT and plain:
                out[:, f, :, k] = out[:, f, :, _ROWS]
                continue
            # every sampled row counts one
            sums = np.bincount(key, None if k == _ROWS else values, size)
            out[:, f, :, k] = sums.reshape(-1, n_bins)[:n_slots]
    return out


@dataclass
class Block:
    """Rows of a task: bins by feature and row, labels, weights, draws and margins."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    draw: np.ndarray
    margin: np.ndarray

    def kinds(self, rules: Rules, number: int) -> np.ndarray:
        """Gradient, Hessian, one and weight of each row of the tree's sample, zeros for the others."""
        p = 1.0 / (1.0 + np.exp(-self.margin))
        kinds = np.empty((4, len(p)))
        kinds[_ROWS] = _draws(self.draw, rules.seed, number) < rules.row_share if rules.row_share < 1.0 else 1.0
        np.multiply(self.weight, kinds[_ROWS], out=kinds[_WEIGHT])
        np.multiply(kinds[_WEIGHT], p - self.label, out=kinds[_GRADIENT])
        np.multiply(kinds[_WEIGHT], p, out=kinds[_HESSIAN])
        kinds[_HESSIAN] *= 1 - p
        return kinds

    def after(self, tree: Tree) -> "Block":
        values = np.array(tree.value)
        added = [values[tree.place(part.bins)] for part in self.chunks(_CHUNK_ROWS)]
        return Block(self.bins, self.label, self.weight, self.draw, self.margin + np.concatenate(added))

    def chunks(self, rows: int) -> Iterator["Block"]:
        for first in range(0, len(self.label), rows):
            part = slice(first, first + rows)
            yield Block(self.bins[:, part], self.label[part], self.weight[part], self.draw[part], self.margin[part])


def _draws(keys: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in [0, 1) of each row for one tree."""
    x = keys + np.uint64((seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _chosen(rules: Rules, number: int, path: int, features: np.ndarray) -> np.ndarray:
    """The features that a node may be split on."""
    if rules.split_features is None or rules.split_features >= len(features):
        return features
    rng = np.random.default_rng([rules.seed, number, path])
    return np.sort(rng.choice(features, rules.split_features, replace=False))


def _tree_features(rules: Rules, number: int, n: int) -> np.ndarray:
    count = max(1, int(n * rules.tree_features))
    if count >= n:
        return np.arange(n)
    return np.sort(np.random.default_rng([rules.seed, number]).choice(n, count, replace=False))


def grow(
    sums_of: Callable[[Tree, list[int]], np.ndarray], rules: Rules, number: int, features: np.ndarray, path: int = 1,
    local_rows: int = 0, rows: float = math.inf, small_rows: int = 0,
) -> tuple[Tree, list[int]]:
    """A tree, and its nodes left unsplit: a root of at most ``local_rows`` rows, or nodes of at most ``small_rows``
    with ``SPARED_LEVELS`` or more below them."""
    tree, aside = Tree(), []
    tree.path[0] = path
    depth_of = lambda node: tree.path[node].bit_length() - 1
    if rows <= local_rows:
        return tree, [0]
    open_ = [0]
    while open_:
        sums = sums_of(tree, open_)
        following = []
        for node, own in zip(open_, sums):
            if node == 0:
                tree.value[0] = leaf_value(own[0].sum(axis=0), rules)
            found = best_split(own, _chosen(rules, number, tree.path[node], features), rules)
            if found is None:
                continue
            _, f, cut = found
            left = own[f, :cut + 1].sum(axis=0)
            right = own[f, cut + 1:].sum(axis=0)
            for child, part in zip(tree.split(node, found, (leaf_value(left, rules), leaf_value(right, rules))), (left, right)):
                below = rules.depth - depth_of(child)
                if below > 0:
                    (aside if below >= SPARED_LEVELS and part[_ROWS] <= small_rows else following).append(child)
        open_ = following
    return tree, aside


def grow_here(bins: np.ndarray, kinds: np.ndarray, rules: Rules, number: int, features: np.ndarray, path: int, n_bins: int) -> Tree:
    """A tree of the given rows, from the node with that path on."""

    def sums_of(tree: Tree, nodes: list[int]) -> np.ndarray:
        slots = np.full(len(tree.feature), -1)
        slots[nodes] = np.arange(len(nodes))
        return histogram(bins, slots[tree.place(bins)], kinds, len(nodes), n_bins)

    return grow(sums_of, rules, number, features, path)[0]


def _grow_tree(blocks: RDD, parts: int, rows: int, rules: Rules, number: int, n_features: int, n_bins: int) -> Tree:
    features = _tree_features(rules, number, n_features)
    node_bytes = n_features * n_bins * 32

    def sums_of(tree: Tree, nodes: list[int]) -> np.ndarray:
        slots = np.full(len(tree.feature), -1)
        slots[nodes] = np.arange(len(nodes))

        def sums(block: Block) -> np.ndarray:
            total = None
            for part in block.chunks(max(_CHUNK_ROWS, 4 * len(nodes) * n_bins)):
                own = histogram(part.bins, slots[tree.place(part.bins)], part.kinds(rules, number), len(nodes), n_bins)
                total = own if total is None else np.add(total, own, out=total)
            return total

        return blocks.map(sums).treeReduce(np.add, 1 if parts * len(nodes) * node_bytes <= _ADDED_BYTES else 2)

    # the sums of a node come from every block; below this number its rows are fewer bytes, and few rows are moved sooner
    # than jobs are started
    small = LOCAL_ROWS if rows <= MOVED_ROWS else min(LOCAL_ROWS, node_bytes * parts // (n_features + 32))
    tree, aside = grow(sums_of, rules, number, features, 1, LOCAL_ROWS if parts == 1 else 0, rows, small)
    if not aside:
        return tree

    def rows_of(block: Block) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        at, kinds = tree.place(block.bins), block.kinds(rules, number)
        sampled = kinds[_ROWS] > 0
        for node in aside:
            own = np.flatnonzero((at == node) & sampled)
            if len(own):
                yield node, (block.bins[:, own], kinds[:, own])

    def finish(node: int, shares: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[int, Tree]:
        bins, kinds = (np.concatenate(x, axis=1) for x in zip(*shares))
        return node, grow_here(bins, kinds, rules, number, features, tree.path[node], n_bins)

    shares = blocks.flatMap(rows_of)
    if parts == 1:
        def alone(items: Iterator) -> Iterator:
            by_node: dict[int, list] = {}
            for node, share in items:
                by_node.setdefault(node, []).append(share)
            for node, own in by_node.items():
                yield finish(node, own)

        grown = shares.mapPartitions(alone)
    else:
        # at most LOCAL_ROWS rows a node; all cores, as this is most of a deep tree's work
        grown = shares.groupByKey(min(max(parts, blocks.ctx.defaultParallelism), len(aside))).map(lambda x: finish(*x))
    for node, below in sorted(grown.collect(), key=lambda x: x[0]):  # at most one tree per node set aside
        tree.graft(node, below)
    return tree


def bin_edges(rows: DataFrame, n_features: int, max_bin: int, quantiles: int | None = None) -> list[np.ndarray]:
    """Thresholds between neighbouring bins of each feature: the least value, below which are the missing ones, and
    midway between quantiles, as many as bins if not told."""
    parts = quantiles or max_bin
    shares = [k / parts for k in range(parts + 1)]
    columns = [F.get("_x", k) for k in range(n_features)]
    kept = [F.when(~F.isnan(c), c) for c in columns]
    row = rows.agg(*[F.percentile_approx(c, shares, 100 * max_bin).alias(f"q{k}") for k, c in enumerate(kept)]).first()
    edges = []
    for k in range(n_features):
        values = np.unique(np.array(row[f"q{k}"] or [], float))
        edges.append(np.concatenate([values[:1], (values[1:] + values[:-1]) / 2])[:max_bin - 1])
    return edges


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins by feature and row; bin k holds the values from threshold k - 1 to below threshold k."""
    out = np.zeros(x.T.shape, np.uint8)
    for f, cuts in enumerate(edges):
        out[f] = np.searchsorted(cuts, np.where(np.isnan(x[:, f]), -np.inf, x[:, f]), side="right")
    return out


def _blocks(rows: DataFrame, edges: list[np.ndarray], parts: int, start: float) -> RDD:
    """Cached blocks, one a partition."""
    n = len(edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), n)
                columns = [to_bins(x, edges), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns],
                                                 names=["bins", "label", "weight", "draw"])

    packed = rows.repartition(parts).mapInArrow(pack, "bins binary, label binary, weight binary, draw binary")

    def join(items: Iterator) -> Iterator[Block]:
        held = list(items)
        if held:
            bins = np.concatenate([np.frombuffer(r.bins, np.uint8).reshape(n, -1) for r in held], axis=1)
            label, weight = (np.concatenate([np.frombuffer(r[c], float) for r in held]) for c in ("label", "weight"))
            draw = np.concatenate([np.frombuffer(r.draw, np.int64) for r in held]).view(np.uint64)
            yield Block(bins, label, weight, draw, np.full(len(label), start))

    return packed.rdd.mapPartitions(join)


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


class NewtonBoosting(Estimator):
    """Estimator over a vector column; learns a :class:`NewtonBoostingModel`.

    ``tasks`` is the number of cores to use, if not all.
    """

    def __init__(self, featuresCol: str, labelCol: str, rules: Rules, weightCol: str | None = None, tasks: int | None = None) -> None:
        super().__init__()
        self.columns = (featuresCol, labelCol, weightCol)
        self.rules, self.tasks = rules, tasks

    def getMaxIter(self) -> int:
        return self.rules.rounds

    def getMaxDepth(self) -> int:
        return self.rules.depth

    def _fit(self, dataset: DataFrame) -> "NewtonBoostingModel":
        features, label, weight = self.columns
        rules, spark = self.rules, dataset.sparkSession
        shared_folder(spark)
        x = vector_to_array(features)
        rows = through_table(
            dataset.select(
                x.alias("_x"), F.col(label).cast("double").alias("_y"),
                (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), F.xxhash64(x, label).alias("_k"),
            ),
            "boosting-rows",
        )
        known = rows.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("f"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("p")
        ).first()
        if not known["n"]:
            raise ValueError("no rows to learn from")
        prior = rules.base_score if rules.base_score is not None else known["p"] / known["w"]
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        start = math.log(prior / (1 - prior))
        edges = bin_edges(rows, known["f"], rules.max_bin)
        n_bins = max(len(e) for e in edges) + 1
        parts = math.ceil(known["n"] * (known["f"] + 32) / BLOCK_BYTES)
        if known["n"] > LOCAL_ROWS:
            cores = self.tasks or spark.sparkContext.defaultParallelism
            parts = max(parts, min(cores, math.ceil(known["n"] / BLOCK_ROWS)))
        blocks = _blocks(rows, edges, parts, start).persist(StorageLevel.MEMORY_AND_DISK)
        held, trees = [blocks], []
        for number in range(rules.rounds):
            tree = _grow_tree(blocks, parts, known["n"], rules, number, known["f"], n_bins)
            trees.append(tree)
            while len(held) > 1:
                held.pop(0).unpersist()
            blocks = blocks.map(lambda block, tree=tree: block.after(tree)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % CHECKPOINT_TREES == CHECKPOINT_TREES - 1:
                blocks.checkpoint()
                blocks.count()
            held.append(blocks)
        for rdd in held:
            rdd.unpersist()
        return NewtonBoostingModel(features)._learned(rules, trees, edges, start, known["f"])


class NewtonBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    learned = Param(Params._dummy(), "learned", "trees, thresholds and rules", TypeConverters.toString)

    def __init__(self, featuresCol: str = "features") -> None:
        super().__init__()
        self._set(featuresCol=featuresCol)

    def _learned(self, rules: Rules, trees: list[Tree], edges: list[np.ndarray], start: float, n: int) -> "NewtonBoostingModel":
        table: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "value", "gain", "root")}
        for tree in trees:
            base = len(table["feature"])
            table["root"].append(base)
            table["feature"] += tree.feature
            table["threshold"] += [float(edges[f][c]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
            table["left"] += [base + k for k in tree.left]
            table["right"] += [base + k for k in tree.right]
            table["value"] += tree.value
            table["gain"] += tree.gain
        self._set(learned=json.dumps({"rules": asdict(rules), "start": start, "n_features": n, **table}))
        return self

    def table(self) -> dict:
        return json.loads(self.getOrDefault(self.learned))

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of all gains."""
        table = self.table()
        feature, gain = np.array(table["feature"]), np.array(table["gain"])
        total = np.bincount(feature[feature >= 0], gain[feature >= 0], table["n_features"])
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        table = self.table()
        start, root = table["start"], table["root"]
        feature, left, right = (np.array(table[c], np.int64) for c in ("feature", "left", "right"))
        threshold, value = np.array(table["threshold"]), np.array(table["value"])

        @F.pandas_udf("double")
        def margin(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            x = np.stack(vectors.to_numpy())
            x = np.where(np.isnan(x), -np.inf, x)
            out = np.full(len(x), start)
            for top in root:
                at, rows = np.full(len(x), top), np.arange(len(x))
                while len(rows):
                    rows = rows[feature[at[rows]] >= 0]
                    node = at[rows]
                    at[rows] = np.where(x[rows, feature[node]] < threshold[node], left[node], right[node])
                out += value[at]
            return pd.Series(out)

        scored = dataset.withColumn("_margin", margin(vector_to_array(self.getOrDefault(self.featuresCol))))
        p = 1.0 / (1.0 + F.exp(-F.col("_margin")))
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))),
                "probability": array_to_vector(F.array(1.0 - p, p)),
                "prediction": (F.col("_margin") > 0).cast("double"),
            }
        ).drop("_margin")
