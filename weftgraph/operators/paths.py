"""Shortest paths with a deterministic choice, from many sources at once.

Of all shortest paths to a node the one with the lexicographically smallest sequence of edge ids is
taken: that is the path a first-in-first-out search over edges in id order would record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.operators.hops import Hops


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """(source, node, depth, edge_path, node_path) for ``sources(source, node)``, up to ``max_depth`` hops.

    ``edges(id, src, dst)``. Edges are stored once (see ``Hops``; a row counts as often as its path is long). Per level one join, one ``min_by`` per (source, node) combined before the
    shuffle, and one anti-join with what the source has seen.
    """
    level = sources.select("source", "node").distinct().withColumns({"depth": F.lit(0), "edge_path": F.array().cast("array<bigint>"), "node_path": F.array("node")})
    seen = level = durable(level)
    hops, rows = Hops(edges.select("id", "src", "dst")), level.count()
    for depth in range(1, max_depth + 1):
        step = hops.step(level, "node", rows * depth).select("source", F.col("dst").alias("node"), F.concat("edge_path", F.array("id")).alias("e"), F.concat("node_path", F.array("dst")).alias("n"))
        step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        best = step.groupBy("source", "node").agg(F.min(F.struct("e", "n")).alias("p"))
        level = durable(best.select("source", "node", F.lit(depth).alias("depth"), F.col("p.e").alias("edge_path"), F.col("p.n").alias("node_path")))
        rows = level.count()
        if not rows:
            break
        seen = seen.unionByName(level)
    hops.drop()
    return seen


def explain(edges: DataFrame, start: int, targets: DataFrame, max_depth: int = 100) -> DataFrame:
    """(node, depth, edge_path, node_path): the chain of parents that led from ``start`` to each target."""
    spark = edges.sparkSession
    found = shortest_paths(edges, spark.createDataFrame([(0, start)], "source long, node long"), max_depth)
    return found.join(targets.select(F.col("id").alias("node")), "node", "left_semi").drop("source")
