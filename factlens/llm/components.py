"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C


#: Nodes whose least neighbours are broadcast, 32 bytes each; with more, a shuffle joins them.
BROADCAST_NODES = 200_000


def _met(near: DataFrame, small: bool) -> DataFrame:
    """`near` (u, v) with m, the least of u and its neighbours in it."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(F.broadcast(least) if small else least, "u")


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """A large-star step and a small-star step over edges (u, v) with u > v, which those of the result are too."""
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    large = _met(edges.select(ways.alias("e")).select("e.u", "e.v"), small).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Equal edges of the large step meet in the small one.
    both = _met(large, small).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
    return both.filter("e.v != e.m").select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).distinct()


def components(spark: SparkSession, links: DataFrame, scratch: C.Scratch, name: str) -> DataFrame:
    """(node, root) of every node of `links` (u, v): root is the least node of its component.

    Nodes without a link to another node are not in the result. Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. Edges are those of a result once every node has one
    edge up and none that is a root has any.
    """
    edges = scratch.write(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    step, many = 0, edges.count()
    while True:
        step += 1
        # A node has an edge, so there are no more than two for each.
        small = 2 * many <= BROADCAST_NODES
        edges = scratch.write(_stars(edges, small), f"{name}-{step}")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")).distinct())
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("up").alias("below"), F.min("up").alias("root"))
        now = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("edges"), F.count_if((F.col("up") > 1) | ((F.col("below") == 1) & (F.col("root") == 0))).alias("open")).first()
        scratch.drop(f"{name}-{step - 1}")
        if not now.open:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        many = now.edges
