"""The one fixpoint helper: a frontier that grows until nothing new is reached."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.store import shared_dir


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): every node that can be reached from any seed, seeds included at depth 0, with the least depth.

    edges: src, dst. A round is one join and one anti join on the node; lineage is cut by a checkpoint a round. Every round finds
    a node at least, so rounds end; there are as many as the longest of the shortest paths has edges.
    """
    shared_dir(edges.sparkSession)  # so that checkpoint() knows where
    edges = edges.select("src", "dst").distinct().checkpoint()
    front = seeds.select("node", F.lit(0).alias("depth")).distinct().checkpoint()
    seen = front
    for depth in itertools.count(1):
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = front.join(seen.select("node"), "node", "left_anti").checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if depth % 8 == 0:
            seen = seen.checkpoint()
