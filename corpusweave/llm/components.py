"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step. Large star: the larger neighbours of a vertex move to the least of its neighbourhood; small
    star: its smaller neighbours and itself do. The least ones are a partial aggregate and come back by a join."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = stage(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
    joined = near.join(least, "u")
    if small:
        moved = joined.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return stage(moved.filter("a != b").distinct(), "star-edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root`` (the least vertex of its component) for every vertex on an edge (``a``, ``b`` longs).

    Self-loops and repeated edges don't matter; vertices without edges are absent. The steps repeat until the
    edges stay as they are, which takes about the square of the logarithm of the longest path.
    """
    now = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = _stars(_stars(now, small=False), small=True)
        found = tuple(
            now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        )
        if found == mark:
            roots = now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        mark = found
