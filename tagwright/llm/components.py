"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.sources.shared import publish


def _with_least(edges: DataFrame, keep: str) -> DataFrame:
    """``(u, v, m)``: each edge with the least neighbour of its ``u``. The least ones are written
    first, so that the join's two sides are both plain shuffles and a hub can be split."""
    least = publish(edges.groupBy("u").agg(F.min("v").alias("m")), keep)
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, "large-star").where("v > u")
    return found.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges already run from the larger ``u`` to the smaller ``v``."""
    found = _with_least(edges, "small-star")
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return found.select(F.explode(ends).alias("e")).select("e.*").where("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with an edge to another node; ``root`` is the least node of
    its component and is itself not listed.

    Alternating large-star and small-star steps; each writes its edges to the shared folder, which
    cuts lineage. The steps end when a round changes nothing. No node's neighbours are collected.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, seen = publish(start, "edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        edges = publish(_small_star(publish(_large_star(edges).distinct(), "edges")).distinct(), "edges")
