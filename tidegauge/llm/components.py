"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.session import through_table


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a checksum, to see whether a round changed anything."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _stars(edges: DataFrame) -> DataFrame:
    """Link each node's neighbours to the least node among them; one edge per pair of nodes.

    The minima are stored before the join, so that a node with very many neighbours can be split.
    """
    least = through_table(edges.groupBy("u").agg(F.min("v").alias("m")), "component-minima")
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with an edge but the roots: the least node it is connected to.

    Every round is kept as a table. Rounds go on until nothing changes, about the logarithm of the
    longest chain.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = through_table(pairs, "component-edges")
    before = None
    now = _state(pairs)
    while now != before:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = through_table(large, "component-edges")
        small = _stars(large)
        small = small.select("u", F.col("m").alias("v")).unionAll(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        pairs = through_table(small.where("u <> v").distinct(), "component-edges")
        before, now = now, _state(pairs)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
