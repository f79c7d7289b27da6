"""Connected components of an edge list, by alternating star operations on distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node that has an edge; ``edges`` has columns a and b.

    Each round ties every node's larger neighbours to its least neighbour, then
    its smaller ones, until the edges are stars (Kiveris and others, 2014). A
    round's edges, no more than those before it, are written below the checkpoint folder, in few files.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", rows=edges.count())
    before, size = None, _summary(now)
    while size != before:
        now = stored(_small_star(_large_star(now)), "edges", rows=size[0])
        before, size = size, _summary(now)
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)


def _summary(edges: DataFrame) -> tuple:
    """Number and hash of a set of edges, to see that a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node, its larger neighbours are tied to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node, its smaller neighbours and itself are tied to the least of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return (tied.unionByName(own).where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
