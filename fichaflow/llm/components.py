"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fichaflow.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b) without nulls: the smallest node that each linked node reaches.

    A round makes two grouped minima with their joins; the number of rounds grows with the logarithm of the longest path.
    The joins are on a node, and adaptive execution splits one with very many links. A round that leaves the edges as they
    are is the last, which their number and a 64-bit checksum tell.
    """
    edges = stored(_down(links.select("a", "b")).distinct(), "links")
    before = _checksum(edges)
    while True:
        large = _star(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), keep_lower=False)
        edges = stored(_star(large, keep_lower=True).distinct(), "links")
        now = _checksum(edges)
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _down(pairs: DataFrame) -> DataFrame:
    """Pairs from the larger to the smaller node."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")


def _star(edges: DataFrame, keep_lower: bool) -> DataFrame:
    """Tie neighbours of each node to the smallest among them and the node.

    Large star: all edges in both directions, neighbours above the node are tied. Small star: edges to lower neighbours, those
    and the node are tied.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    tied = edges.join(low, "a")
    if keep_lower:
        own = low.select("a", F.col("low").alias("b"))
        return _down(tied.select(F.col("b").alias("a"), F.col("low").alias("b")).union(own))
    return _down(tied.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))
