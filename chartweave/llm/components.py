"""Connected components by alternating large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (columns ``a`` and ``b`` of one type that has an order).

    The component is its smallest node. Every step ends in distinct edges towards smaller nodes, so a large
    component becomes a star and never a list of pairs; edges and labels stay on the executors. Edges with a
    null end or of a node with itself are left out, so nodes without other edges have no row.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most):
        if stars(now):
            break
        # large star: every larger neighbour of a node, to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(spread_join(both.where(F.col("b") > F.col("a")), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: a node and its smaller neighbours, to the smallest of them
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        now = cut(small.where(F.col("a") != F.col("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    # every edge now leads from a node to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge towards a smaller one, or only edges from larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not by_node.where("up + down > 1").head(1)
