"""Connected components of an edge table by alternating large and small stars.

Every step is a join and a partial aggregate on one vertex, so a hub with a third of all edges is split by the
planner's skew handling and pre-aggregated before it moves; nothing but whether it is done reaches the driver. Each
round is cut as a table in the shared folder, made once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Link each vertex' neighbours to the smallest vertex in reach."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1 and out > 0").isEmpty()


def connected(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(vertex, component) of every vertex in edges (a, b); the component is the smallest vertex. Loops, repeats and nulls are ignored.

    Every round that isn't the last moves a vertex to a smaller one, so rounds end. paths gets the scratch tables' paths.
    """
    now, done = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), False
    while not done:
        now = scratch(_star(_star(now, large=True), large=False), "stars", paths)
        done = _done(now)
    leaves = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
