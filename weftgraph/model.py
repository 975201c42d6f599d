"""The property graph: two tables, fixed kinds, and an explicit order column (``id``) in each.

Order is part of the value: ids are dense and give creation order. Kind codes are part of the
fingerprint and never change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in the order of their codes, from 0.
NODE_KINDS = ("AstNode", "CfgNode", "DfgValue", "Symbol", "Function", "File")
EDGE_KINDS = ("AstParent", "AstChild", "ControlFlow", "DataFlow", "Defines", "Uses", "Calls", "PointsTo")
CFG_NODE_KINDS = ("Entry", "Exit", "Statement", "Branch", "LoopHeader", "Merge")
CFG_EDGE_KINDS = ("Normal", "True", "False", "Break", "Continue")
DFG_EDGE_KINDS = ("Definition", "Use", "PhiLike")
SYMBOL_KINDS = ("Function", "Variable", "Parameter", "Constant")
SCOPE_KINDS = ("File", "Function", "Block")
VALUE_KINDS = ("Variable", "Constant", "Parameter", "Temporary")


TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "tinyint": T.ByteType(), "timestamp": T.TimestampType()}


def _struct(spec: str, **more: T.DataType) -> T.StructType:
    """A schema of "name type, ..." without a session; ``more`` names further types."""
    known = TYPES | more
    return T.StructType([T.StructField(name, known[kind]) for name, kind in (x.split() for x in spec.split(","))])


ORIGIN = _struct("tag string, file_id string, function_id bigint, local_id bigint, range_start bigint, range_end bigint")
VALUE = _struct("tag string, name string, value string, position int")
SCHEMAS: dict[str, T.StructType] = {
    "files": _struct("file_id string, path string, size bigint, mtime timestamp, content_hash string, language string"),
    "ast": _struct("file_id string, node_id bigint, parent_id bigint, child_index int, kind string, field string, start bigint, end bigint, depth int"),
    "cfg_nodes": _struct("file_id string, function_id bigint, node_id bigint, kind string, range_start bigint, range_end bigint, statement string"),
    "cfg_edges": _struct("file_id string, function_id bigint, seq bigint, src bigint, dst bigint, kind string"),
    "dfg_values": _struct("file_id string, function_id bigint, value_id bigint, value VALUE, range_start bigint, range_end bigint", VALUE=VALUE),
    "dfg_edges": _struct("file_id string, function_id bigint, seq bigint, src bigint, dst bigint, kind string"),
    "scopes": _struct("file_id string, scope_id bigint, parent_id bigint, kind string"),
    "symbols": _struct("file_id string, symbol_id bigint, name string, range_start bigint, range_end bigint, scope_id bigint, kind string"),
    "nodes": _struct("id bigint, kind string, kind_code tinyint, origin ORIGIN, range_start bigint, range_end bigint, label string", ORIGIN=ORIGIN),
    "edges": _struct("id bigint, kind string, kind_code tinyint, src bigint, dst bigint"),
}


class InvariantError(RuntimeError):
    """A broken invariant: the engine raises rather than answer in part."""


def code_of(kind: Column, kinds: tuple[str, ...]) -> Column:
    """The kind's code; null for an unknown kind (``checked`` raises on it)."""
    at = F.array_position(F.array(*(F.lit(k) for k in kinds)), kind)
    return F.when(at > 0, at - 1).cast("tinyint")


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes(id, kind, ...)`` and ``edges(id, kind, src, dst, ...)`` of one immutable epoch."""

    nodes: DataFrame
    edges: DataFrame
    epoch_id: int = 1

    def cached(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.cache(), self.edges.cache(), self.epoch_id)

    def drop(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def checked(self, linked: bool = True) -> PropertyGraph:
        """Itself, or InvariantError: ranges run forward, kinds are known and, if ``linked``, edges end at nodes."""
        cols = self.nodes.columns
        if "range_start" in cols and not self.nodes.filter("range_start > range_end").isEmpty():
            raise InvariantError("a range ends before it starts")
        for df, kinds in ((self.nodes, NODE_KINDS), (self.edges, EDGE_KINDS)):
            if not df.filter(~F.col("kind").isin(*kinds)).isEmpty():
                raise InvariantError("unknown kind")
        if linked:
            ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id")))
            if not ends.join(self.nodes, "id", "left_anti").isEmpty():
                raise InvariantError("an edge ends at no node")
        return self
