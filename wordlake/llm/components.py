"""Connected components of an edge table by alternating star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.session import cut_lineage


def _to_least(near: DataFrame) -> DataFrame:
    """``near`` (u, v) with m, the least of u and its neighbours; partial aggregation, so a hub is no hot group."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge joins to another; ``component`` is the least node id.

    Edges may repeat, run either way or join a node to itself; null ends are ignored. No edges give no rows.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct())
    while True:
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
        if ends.where("up > 1 or (up = 1 and top = 1)").isEmpty():  # stars, each around its least node
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large)
        e = cut_lineage(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
