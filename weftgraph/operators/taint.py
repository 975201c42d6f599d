"""Bounded taint analysis over DataFlow edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.operators.paths import shortest_paths

#: A node at this depth is neither tainted nor tested: 49 hops at most.
MAX_DEPTH = 50
# Kinds that callers give their sources and sinks.
SOURCE_KINDS = ("Parameter", "ExternalInput")
SINK_KINDS = ("FunctionCall", "Return")


@dataclass(frozen=True)
class TaintResult:
    """``paths``: a row per source and matching sink entry; ``visited``: (source, node, depth)."""

    paths: DataFrame
    visited: DataFrame

    def tainted(self) -> DataFrame:
        """(node): what any source reaches, sources included."""
        return self.visited.select("node").distinct()

    def is_tainted(self, nodes: DataFrame) -> DataFrame:
        """``nodes(node)`` with a boolean ``tainted``."""
        hit = self.tainted().withColumn("_hit", F.lit(True))
        return nodes.join(hit, "node", "left").withColumn("tainted", F.col("_hit").isNotNull()).drop("_hit")

    def stats(self) -> DataFrame:
        """(paths, tainted_nodes)."""
        return self.paths.agg(F.count("*").alias("paths")).crossJoin(self.tainted().agg(F.count("*").alias("tainted_nodes")))  # one row each


def analyze(edges: DataFrame, sources: DataFrame, sinks: DataFrame, edge_kinds: tuple[str, ...] = ("DataFlow",), max_depth: int = MAX_DEPTH) -> TaintResult:
    """Each of ``sources(source, kind, node)`` searches alone; ``sinks(kind, node)`` may repeat nodes.

    Edge ids give the order among equal paths. A source that is a sink has a path of one node. Paths
    come with source_kind and sink_kind; their order is (source, depth, edge_path).
    """
    flow = edges.filter(F.col("kind").isin(*edge_kinds)).select("id", "src", "dst")
    found = durable(shortest_paths(flow, sources.select("source", "node"), max_depth - 1))
    ends = sinks.select(F.col("kind").alias("sink_kind"), F.col("node").alias("sink_id"))
    named = sources.select("source", F.col("kind").alias("source_kind"), F.col("node").alias("source_id"))
    paths = found.join(ends, found["node"] == ends["sink_id"]).join(named, "source").select("source", "source_kind", "source_id", "sink_kind", "sink_id", "depth", "edge_path", "node_path")
    return TaintResult(paths, found.select("source", "node", "depth"))
