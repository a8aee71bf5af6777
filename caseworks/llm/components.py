"""Connected components by alternating large-star and small-star steps on tables of links.

Behaviour at the edges: links that repeat, or come either way round, count once; a link of a node with itself, or with a null, is no link;
without links the result has no rows; columns other than u and v are ignored. Nodes are compared as Spark orders them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseworks.llm.workspace import drop, join_hot, settle


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(links: DataFrame, total: int) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it; total is the number of links."""
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("__cw_n"))
    return join_hot(near.filter("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; links come as (larger u, smaller v), total of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__cw_n"))
    moved = join_hot(links, least, "u", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) for each node u that is not the smallest of its component, with the smallest, v. links has pairs (u, v), u <> v, either way round."""
    real = links.filter("u <> v")  # drops nulls, too
    now = settle(real.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        marks = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if marks[0] == 0 or marks == seen:
            return now
        seen = marks
        large = settle(large_star(now, marks[0]), "links")
        after = settle(small_star(large, marks[0]), "links")
        drop(now, large)
        now = after
