"""Program-graph operators over edges (src, dst, kind) and nodes (program, node, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.iterate import spread
from gneiss.operators.store import stored


def callees(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of every edge but fall-through ones."""
    return edges.filter("kind <> 'fallthrough'").select("src", "dst").distinct()


def callers(edges: DataFrame) -> DataFrame:
    """Distinct callers of each node, counted and listed in order."""
    return callees(edges).groupBy("dst").agg(F.count("*").alias("n_callers"), F.min("src").alias("first_caller"), F.max("src").alias("last_caller"))


def fallthrough(nodes: DataFrame) -> DataFrame:
    """An edge from every node to the next in its program, unless it transfers control. nodes: program, ord, node, transfers."""
    after = F.lead("node").over(Window.partitionBy("program").orderBy("ord"))
    return nodes.select("program", F.col("node").alias("src"), after.alias("dst"), "transfers").filter(~F.col("transfers") & F.col("dst").isNotNull()).select("program", "src", "dst")


def entry_points(nodes: DataFrame) -> DataFrame:
    """The first node of every program."""
    return nodes.groupBy("program").agg(F.min_by("node", "ord").alias("node"))


def forest_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge of any kind, entry points left out."""
    rest = nodes.select("program", "node").join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return rest.join(entry_points(nodes), ["program", "node"], "left_anti")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct nodes in reach of any seed, seeds included."""
    return depths(edges, seeds).select("node")


def depths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): the length of the shortest path from any seed."""
    return spread(edges, seeds)


def dead(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes out of reach of every seed."""
    return nodes.select("node").distinct().join(reachable(edges, seeds), "node", "left_anti")


def thru(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Every node from low to high, for calls (program, low, high) over nodes (program, ord, node); backward ranges are unresolved."""
    good = calls.filter("low <= high")
    return good.join(nodes, (good["program"] == nodes["program"]) & nodes["ord"].between(good["low"], good["high"])).select(good["program"], "low", "high", "node")


def shortest_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth, path): a shortest path from a seed to every node in reach, as an array of nodes; of several the one with the least predecessor at each step back.

    Parents come from the depths, by one join: the least source of an edge whose depth is one less. Paths are then put together by
    doubling: each round joins what a node has of its path with what the path's first node has, so a path of n edges takes log2(n) rounds.
    """
    far = stored(depths(edges, seeds), "depths")
    by = edges.select("src", "dst").distinct().join(far.select(F.col("node").alias("src"), F.col("depth").alias("before")), "src")
    parent = by.join(far.select(F.col("node").alias("dst"), "depth"), "dst").filter("before = depth - 1").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    # head is the first node of what is known of the path; a seed's head is null
    known = stored(far.join(parent, "node", "left").select("node", "depth", F.col("parent").alias("head"), F.array("node").alias("path")), "paths")
    while not known.filter("head is not null").isEmpty():
        up = known.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("path").alias("front"))
        open_ = known.filter("head is not null").join(up, "head").select("node", "depth", F.col("next").alias("head"), F.concat("front", "path").alias("path"))
        known = stored(known.filter("head is null").unionByName(open_), "paths")
    return known.select("node", "depth", "path")
