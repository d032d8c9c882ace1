"""Connected components by alternating stars, for links between any number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``a, b``): the smallest node reachable.

    Both stars keep the components and shorten the paths, so after about the logarithm of
    the longest path every node is linked to its smallest one. A round is minima per node
    and joins, written to a table; nothing but two numbers per round reaches the driver.
    A node with very many links is minima and a join that Spark can split, no group.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    table = scratch.write(edges.distinct(), "edges")
    before = _mark(table)
    while before[0]:
        large = _large_star(table).filter("a <> b").distinct()
        following = scratch.write(_small_star(large).filter("a <> b").distinct(), "edges")
        scratch.drop(table)
        table, after = following, _mark(following)
        if after == before:
            break
        before = after
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
