"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and one join, in which nodes of very many
edges are met by broadcast; nothing is collected and no neighbour list is built. Rounds grow with the
logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_skewed, stored


def _least_neighbour(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with m, the least of u and its neighbours; total: edges, at most."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_n"))
    return join_skewed(edges, least, ["u"], total).select("u", "v", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    near = _least_neighbour(edges, total)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of two equal orderable types -> (node, root): root is the least node reachable.

    Nodes without an edge do not appear. Loops, repeated edges and edges with a null end are ignored."""
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    (e, path), seen = stored(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen, last = now, path
        large, between = stored(_large_star(e, now[0]), "stars")
        e, path = stored(_small_star(large, now[0]), "edges")
        discard(spark, last)
        discard(spark, between)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
