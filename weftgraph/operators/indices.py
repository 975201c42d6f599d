"""The four indices of an epoch, as grouped tables that any later plan can join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ordering import ordered_list


def node_edges(edges: DataFrame) -> DataFrame:
    """(src, kind, edge_ids): out-edges by node and kind, in id order."""
    return edges.groupBy("src", "kind").agg(F.array_sort(F.collect_list("id")).alias("edge_ids"))


def symbol_defs(nodes: DataFrame) -> DataFrame:
    """(file_id, symbol_id, node_ids): Symbol nodes by the symbol they came from."""
    s = nodes.filter((F.col("kind") == "Symbol") & (F.col("origin.tag") == "Symbol"))
    return s.groupBy(F.col("origin.file_id").alias("file_id"), F.col("origin.local_id").alias("symbol_id")).agg(F.array_sort(F.collect_list("id")).alias("node_ids"))


def var_uses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, function_id, value_id, uses): sources of the DataFlow edges into each value, in edge order."""
    v = nodes.filter((F.col("kind") == "DfgValue") & (F.col("origin.tag") == "Dfg")).select("id", "origin")
    e = edges.filter(F.col("kind") == "DataFlow").select(F.col("id").alias("eid"), "src", "dst")
    joined = e.join(v, e["dst"] == v["id"])
    return joined.groupBy(F.col("origin.file_id").alias("file_id"), F.col("origin.function_id").alias("function_id"), F.col("origin.local_id").alias("value_id")).agg(ordered_list(F.col("eid"), F.col("src")).alias("uses"))


def func_calls(nodes: DataFrame, edges: DataFrame, edge_kind: str = "Calls", node_kind: str = "Function") -> DataFrame:
    """(id, callers): sources of the Calls edges into each Function node, in edge order."""
    f = nodes.filter(F.col("kind") == node_kind).select(F.col("id").alias("fid"))
    e = edges.filter(F.col("kind") == edge_kind).select(F.col("id").alias("eid"), "src", "dst")
    return e.join(f, e["dst"] == f["fid"]).groupBy(F.col("fid").alias("id")).agg(ordered_list(F.col("eid"), F.col("src")).alias("callers"))


@dataclass(frozen=True)
class Indices:
    node_edges: DataFrame
    symbol_defs: DataFrame
    var_uses: DataFrame
    func_calls: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame) -> Indices:
        return cls(node_edges(edges).cache(), symbol_defs(nodes), var_uses(nodes, edges), func_calls(nodes, edges))

    def edges_of(self, src: int, kind: str) -> DataFrame:
        """(id): ids of the node's edges of a kind, from the cached index."""
        return self.node_edges.filter((F.col("src") == src) & (F.col("kind") == kind)).select(F.explode("edge_ids").alias("id"))
