"""Connected components of a graph given as an edge table, without holding any of it on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: join the neighbours of each node that are larger (or not) to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _written(edges: DataFrame) -> DataFrame:
    """As new columns: what a checkpoint still knows of its origin's constraints does not fit the unions here."""
    return checkpointed(edges).select(F.expr("u + 0L").alias("u"), F.expr("v + 0L").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) for each node of the edges (u, v), by alternating large and small stars.

    Each round is written to the shared folder, so a lost executor costs a part
    of one round; the number of rounds grows with the logarithm of the graph.
    """
    edges = _written(edges.where("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before or not state[0]:
            break
        before = state
        edges = _written(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
