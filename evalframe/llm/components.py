"""Distributed connected components by alternating large-star and small-star steps.

Each step is an aggregation (the least neighbour of each node, combined on the
map side) and a join back to the edges, which Spark can split where a node has
very many edges. Edges are written between steps. Nothing is collected but one
row of counts per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import cut


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b: links all smaller neighbours of a, and a, to the least one."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(low, "a")
    other = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.unionByName(low.withColumnRenamed("m", "b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, the component being its least node. Columns ``a`` and ``b``.

    Loops, repeated edges and nulls are dropped. Edges need not be ordered.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        e = cut(_small_star(_large_star(e)))
        # stars alone are left if no node is both a centre and linked to another
        new = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
