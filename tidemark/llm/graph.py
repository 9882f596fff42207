"""Connected components of an edge table by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none that others point to has any: then the edges are the answer."""
    end = lambda c, down, hub: F.struct(F.col(c).alias("node"), F.lit(down).alias("down"), F.lit(hub).alias("hub"))
    ends = edges.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.hub").alias("hub"))
    return seen.where("down > 1 or (down = 1 and hub = 1)").isEmpty()


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step: the neighbours that are larger (large star) or not larger (small star) than a node join its least one."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    # Both sides of the join are exchanged anew, so that Spark can split the partition of a node with very many edges.
    least = cut(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return cut(out.where("u <> v").distinct(), rows)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its component, itself included. `rows`
    bounds the number of edges, if known. Edges with a null end and of a node with itself count for nothing, repeated
    edges once, further columns not at all; no edges give an empty table."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), rows)
    while not _stars(edges):
        n = 2 * edges.count()
        edges = _star(_star(edges, True, n), False, n)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
