"""The JSON query language: one object, or a list of steps that feed each other.

    {"op": "find_nodes", "kind": "Function"}
    {"op": "follow_edge", "from": 3, "kind": "ControlFlow"}
    {"op": "filter", "ids": [1, 2], "kind": "File"}
    {"op": "intersect", "a": <query or ids>, "b": <query or ids>}
    {"op": "reachable_within", "from": 3, "depth": 4}
    {"steps": [{"op": "find_nodes", "kind": "Function"}, {"op": "follow_edge", "kind": "Calls"}]}

A step without ``from``/``ids``/``a`` takes the ids of the step before it.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import PropertyGraph
from weftgraph.operators import primitives as P

# The fields that each operator may have.
FIELDS = {"find_nodes": {"kind"}, "follow_edge": {"from", "kind"}, "filter": {"ids", "kind"}, "intersect": {"a", "b"}, "reachable_within": {"from", "depth"}}


class QueryError(ValueError):
    """A query that is not understood; nothing of it is run."""


def compile_query(graph: PropertyGraph, query: str | dict) -> DataFrame:
    """(seq, id) - the plan of the query; nothing runs yet but the levels of a reachability."""
    q = json.loads(query) if isinstance(query, str) else query
    if not isinstance(q, dict):
        raise QueryError("a query is an object")
    if "steps" in q:
        if set(q) != {"steps"} or not isinstance(q["steps"], list) or not q["steps"]:
            raise QueryError("steps is a list of queries, alone in its object")
        out = None
        for step in q["steps"]:
            out = _step(graph, step, out)
        return out
    return _step(graph, q, None)


def _operand(graph: PropertyGraph, value: Any, before: DataFrame | None) -> DataFrame:
    if value is None:
        if before is None:
            raise QueryError("the first step needs its ids")
        return before
    if isinstance(value, dict):
        return compile_query(graph, value)
    ids = value if isinstance(value, list) else [value]
    if not all(isinstance(x, int) and not isinstance(x, bool) for x in ids):
        raise QueryError("ids are integers")
    return graph.nodes.sparkSession.createDataFrame(list(enumerate(ids)), "seq long, id long")


def _step(graph: PropertyGraph, q: Any, before: DataFrame | None) -> DataFrame:
    op = q.get("op") if isinstance(q, dict) else None
    if op not in FIELDS:
        raise QueryError(f"unknown operator {op!r}")
    if extra := set(q) - FIELDS[op] - {"op"}:
        raise QueryError(f"{op} has no field {sorted(extra)[0]!r}")
    if op == "find_nodes":
        return P.find_nodes(graph.nodes, q["kind"]).select(F.col("id").alias("seq"), "id")
    if op == "follow_edge":
        starts = _operand(graph, q.get("from"), before)
        hop = P.follow_edges(starts, graph.edges, q["kind"])
        return hop.select(F.col("edge_id").alias("seq"), "id")
    if op == "filter":
        return P.filter_ids(_operand(graph, q.get("ids"), before), graph.nodes, q.get("kind"))
    if op == "intersect":
        return P.intersect(_operand(graph, q.get("a"), before), _operand(graph, q["b"], None))
    starts = _operand(graph, q.get("from"), before)
    return P.reachable_within(graph.edges, starts.select("id"), int(q.get("depth", P.MAX_HOPS))).select(F.col("depth").cast("long").alias("seq"), "id")
