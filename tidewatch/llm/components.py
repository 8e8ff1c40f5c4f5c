"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges(a, b).

    Large-star and small-star steps in turn, each a minimum by key and a join, until nothing changes;
    the number of turns grows with the logarithm of a component's length. A node with many edges is
    dealt to several tasks. Each turn is written to the shared folder. Loops and repeated edges are
    allowed; edges with a null are left out.
    """
    edges = edges.dropna().where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        n = 2 * now[0]
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: a node's larger neighbours go to the smallest of it and its neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.where("b > a"), least, ["a"], n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, ["a"], n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        done, edges = edges, stored(small, "edges")
        discard(done)
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
