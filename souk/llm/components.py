"""Connected components of a graph given as edges, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import write_shared


def _smallest(edges: DataFrame) -> DataFrame:
    """u -> the smallest node among u and its neighbours, for every u of (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge (a, b: long).

    Alternating large and small stars: every round hangs a node's larger
    neighbours, then its smaller ones, on the smallest of them.  Each is an
    aggregation and a join, so no node's neighbours are gathered in one place;
    the rounds needed grow with the logarithm of the longest path.
    """
    edges = write_shared(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_smallest(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # here u > v throughout, so a node's neighbours are the smaller ones
        low = _smallest(large)
        small = large.join(low, "u")
        edges = write_shared(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                             .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
