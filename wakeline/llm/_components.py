"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm._shared import keep


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with their u's m. The key is u's complement: so Spark shuffles both sides for the join and can split a node of
    very many edges, which it cannot where one side already lies grouped by u."""
    return edges.withColumn("k", F.bitwise_not(F.col("u"))).join(least.select(F.bitwise_not(F.col("u")).alias("k"), "m"), "k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to u's least neighbour instead of u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every neighbour below it are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _with_least(down, least).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))


def components(edges: DataFrame) -> DataFrame:
    """node, component for the nodes of edges (u, v); a component is named by its least node.

    Each round is written to the shared folder; rounds end when the edges no longer change, after a number that grows
    with the logarithm of the longest chain.
    """
    clean = lambda e: e.where("u != v").distinct()
    now, seen = keep(clean(edges), "edges"), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = keep(clean(_small_star(clean(_large_star(now)))), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
