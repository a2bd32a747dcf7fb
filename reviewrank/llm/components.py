"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.session import Scratch


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node its component holds.

    Alternates two star operations until nothing changes: every node hands its larger neighbours, then all its
    neighbours, to the smallest node it knows.  Rounds grow with the logarithm of a component's size.  The
    neighbourhood of a node is reduced to its minimum before it moves and is never gathered, so a hub of any degree is
    spread over tasks.  Each round is a written table in the shared folder that takes the place of the last.  No links give no rows; loops are ignored.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.cut(_down(links.select("a", "b")))
    before = None
    while True:
        edges = scratch.cut(_small_star(_large_star(edges)), edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    ends = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return ends.unionByName(roots)


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
