"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014). Every round is one partial aggregation and one join, so no
neighbourhood is ever gathered in a task. The minimum of each node is joined back under a
key of its own, which makes both sides of the join plain exchanges: adaptive execution
can then split the rows of a node that has very many neighbours. An edge's larger node
comes first. What is stars already takes no round, so groups that are known can be given
as stars, and only the edges that were added since cost any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import checkpoint


def _with_minimum(edges: DataFrame, minimum: DataFrame) -> DataFrame:
    left = edges.withColumn("_key", F.col("u").cast("string"))
    right = minimum.select(F.col("u").cast("string").alias("_key"), "m")
    return left.join(right, "_key").drop("_key")


def _both(first: tuple[str, str], second: tuple[str, str]) -> Column:
    """Two rows (u, v) of one, so that the plan below stands there once and not for each of them."""
    return F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (first, second))))


def _large_star(edges: DataFrame) -> DataFrame:
    minimum = edges.select(_both(("u", "v"), ("v", "u"))).groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _with_minimum(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), minimum).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    minimum = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _with_minimum(edges, minimum).select(_both(("v", "m"), ("u", "m")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is below one other that is below none."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or n = 1 and least = 0").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node of the node's component.

    Only nodes that have an edge to another node appear; edges with a null end and
    self-loops are ignored, repeated edges count once, and no edges give no rows.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    now = checkpoint(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(now):
        now = checkpoint(_small_star(_large_star(now)).where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
