"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): the smallest node reachable, itself included.

    Alternates two rewirings until nothing changes: every node ties its larger
    neighbours to the smallest it sees, then its smaller neighbours likewise.
    Both are an aggregate with map-side combine and a join back, so a node with
    very many neighbours is split by AQE and never gathered in one task. Each
    round is a staged table. Self loops and nulls are left out; an empty table
    gives an empty result.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        now = stage(_small_star(_large_star(now)).distinct())
    tied = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().join(tied.select(F.col("a").alias("node")), "node", "left_anti")
    return tied.select(F.col("a").alias("node"), "component").union(
        roots.select("node", F.col("node").alias("component"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b")))
