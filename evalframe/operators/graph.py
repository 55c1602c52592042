"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum, combined on the map side, and a join back to the
edges; edges are written to the session's shared folder between steps, so that a
lost executor costs no more than a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.sources.shared import checkpointed


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges from larger to smaller nodes: links a node and its neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    rest = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.unionByName(least.withColumnRenamed("low", "b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of a node to the least of it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (``a``, ``b``), which may be of any type with an order; the component is its least node.

    Loops, repeated edges and edges with a null end are left out. Settles in rounds about logarithmic in the longest
    path; raises if ``rounds`` are not enough.
    """
    proper = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen = checkpointed(proper.distinct()), None
    for _ in range(rounds):
        now = checkpointed(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if state == seen:
            centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return centres.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("component")))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
