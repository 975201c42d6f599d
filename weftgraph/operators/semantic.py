"""The semantic epoch: per-file control flow, data flow and symbols, and the tracker of what depends on what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.changes import invalidated_edges, invalidated_nodes
from weftgraph.operators.fusion import KEYS, build_dfg
from weftgraph.sources.rust import Facts


@dataclass(frozen=True)
class SemanticEpoch:
    """Immutable tables keyed by file; dropping an epoch drops its lineage."""

    facts: Facts
    dfg_values: DataFrame
    dfg_edges: DataFrame
    epoch_id: int

    @classmethod
    def build(cls, facts: Facts, epoch_id: int) -> SemanticEpoch:
        return cls(facts, *build_dfg(facts), epoch_id)

    def of_file(self, table: str, file_id: str) -> DataFrame:
        """One file's rows of ``cfg_nodes``, ``cfg_edges``, ``scopes``, ``symbols``, ``dfg_values`` or ``dfg_edges``."""
        df = getattr(self, table) if table.startswith("dfg") else getattr(self.facts, table)
        return df.filter(F.col("file_id") == file_id)

    def get_node(self, file_id: str, function_id: int, node_id: int) -> DataFrame:
        """The control-flow node with the id, or no row."""
        return self.of_file("cfg_nodes", file_id).filter((F.col("function_id") == function_id) & (F.col("node_id") == node_id)).limit(1)

    def get_value(self, file_id: str, function_id: int, value_id: int) -> DataFrame:
        """The data-flow value with the id, or no row."""
        return self.of_file("dfg_values", file_id).filter((F.col("function_id") == function_id) & (F.col("value_id") == value_id)).limit(1)

    def file_ids(self) -> DataFrame:
        """(file_id): files with any table; sort by it for the epoch's order."""
        parts = [df.select("file_id") for df in (self.facts.cfg_nodes, self.dfg_values, self.facts.symbols, self.facts.scopes)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def ast_to_cfg(self) -> DataFrame:
        """(file_id, function_id, range_start, range_end, node_id): tracked ranges of CFG nodes."""
        return self.facts.cfg_nodes.select(*KEYS, "range_start", "range_end", "node_id")

    def cfg_to_dfg(self) -> DataFrame:
        """(file_id, function_id, node_id, edge_id): data-flow edges at the value that a node's statement defines."""
        at = self.dfg_values.join(self.ast_to_cfg().join(self.facts.cfg_nodes.filter("kind = 'Statement'").select(*KEYS, "node_id"), [*KEYS, "node_id"], "left_semi"), [*KEYS, "range_start", "range_end"])
        ends = self.dfg_edges.select(*KEYS, F.col("seq").alias("edge_id"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("value_id"))
        return at.join(ends, [*KEYS, "value_id"]).select(*KEYS, "node_id", "edge_id").distinct()

    def invalidate(self, changed: DataFrame, width: int = 256) -> tuple[DataFrame, DataFrame]:
        """(nodes, data-flow edges) that ``changed(file_id, start, end)`` touches."""
        nodes = invalidated_nodes(self.ast_to_cfg().select("file_id", "range_start", "range_end", F.struct("function_id", "node_id").alias("node_id")), changed, ["file_id"], width)
        nodes = nodes.select("file_id", "node_id.function_id", "node_id.node_id")
        return nodes, invalidated_edges(nodes, self.cfg_to_dfg(), KEYS)

    def stats(self) -> DataFrame:
        """(epoch_id, files, cfgs, dfgs, tracked_ranges, tracked_nodes), one row."""
        count = lambda df, what, name: df.agg(F.count_distinct(*what).alias(name))
        rows = [count(self.facts.scopes, ["file_id"], "files"), count(self.facts.cfg_nodes, KEYS, "cfgs"), count(self.dfg_values, KEYS, "dfgs"), count(self.ast_to_cfg(), ["file_id", "range_start", "range_end"], "tracked_ranges"), count(self.cfg_to_dfg(), [*KEYS, "node_id"], "tracked_nodes")]
        out = rows[0]
        for r in rows[1:]:
            out = out.crossJoin(r)  # one row each
        return out.select(F.lit(self.epoch_id).cast("long").alias("epoch_id"), "files", "cfgs", "dfgs", "tracked_ranges", "tracked_nodes")
