"""Fusion: control flow, data flow and symbols of all files become one property graph.

Order of nodes: files by id; in a file the File node, then each function with its CFG nodes, then
data-flow values, then the symbols of the file scope. Order of edges: per file control flow, then data
flow. Ids are dense over all files, from prefix sums of per-file counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.functions.ordering import dense_ids
from weftgraph.model import EDGE_KINDS, NODE_KINDS, PropertyGraph, code_of
from weftgraph.operators import dataflow
from weftgraph.sources.rust import Facts

KEYS = ["file_id", "function_id"]


def build_dfg(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(dfg_values, dfg_edges) of all functions.

    Values: one per defining statement, in node order, then one per phi (a Merge of two predecessors
    that two or more definitions of a variable reach), by node and name. Edges: Use from each definition
    that reaches a defining statement which names its variable, then PhiLike from each merged definition.
    """
    n = facts.cfg_nodes.withColumn("var", F.when(F.col("kind") == "Statement", dataflow.defined_name(F.col("statement"))))
    defs = n.filter("var IS NOT NULL").select(*KEYS, "node_id", "var", "statement", "range_start", "range_end")
    reach = dataflow.reaching_definitions(n.select(*KEYS, "node_id", "var", F.col("node_id").alias("def_id")), facts.cfg_edges, KEYS)
    merges = dataflow.merge_nodes(facts.cfg_nodes, facts.cfg_edges, KEYS)
    phis = dataflow.phi_values(reach, merges, KEYS)
    raw = defs.select(*KEYS, F.lit(0).alias("part"), "node_id", "var", "range_start", "range_end").unionByName(phis.select(*KEYS, F.lit(1).alias("part"), "node_id", "var", F.lit(0).cast("long").alias("range_start"), F.lit(0).cast("long").alias("range_end")))
    order = ["part", "node_id", "var"]
    numbered = durable(dense_ids(raw, ["part"], order[1:], "value_id", within=KEYS))
    tag = F.struct(F.lit("Variable").alias("tag"), F.col("var").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("position"))
    values = numbered.select(*KEYS, "value_id", tag.alias("value"), "range_start", "range_end")
    made = numbered.filter("part = 0").select(*KEYS, F.col("node_id").alias("def_id"), "var", F.col("value_id").alias("src"))
    words = F.regexp_extract_all(F.regexp_replace("statement", r"^[^=]*=", ""), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    named = defs.select(*KEYS, "node_id", F.col("var").alias("own"), F.explode(F.array_distinct(words)).alias("var"))
    target = numbered.filter("part = 0").select(*KEYS, "node_id", F.col("value_id").alias("dst"))
    uses = named.join(reach, [*KEYS, "node_id", "var"]).join(made, [*KEYS, "def_id", "var"]).join(target, [*KEYS, "node_id"]).select(*KEYS, F.lit(0).alias("part"), "dst", "src", F.lit("Use").alias("kind"))
    phi_id = numbered.filter("part = 1").select(*KEYS, "node_id", "var", F.col("value_id").alias("dst"))
    joins = phis.select(*KEYS, "node_id", "var", F.explode("defs").alias("def_id")).join(phi_id, [*KEYS, "node_id", "var"]).join(made, [*KEYS, "def_id", "var"]).select(*KEYS, F.lit(1).alias("part"), "dst", "src", F.lit("PhiLike").alias("kind"))
    edges = dense_ids(uses.unionByName(joins).distinct(), ["part"], ["dst", "src"], "seq", within=KEYS)
    return values, edges.select(*KEYS, "seq", "src", "dst", "kind")


def _origin(tag: str, function: str | None, local: str | None):
    long = lambda x: F.lit(None).cast("long") if x is None else F.col(x)
    return F.struct(F.lit(tag).alias("tag"), F.col("file_id"), long(function).alias("function_id"), long(local).alias("local_id"), F.lit(None).cast("long").alias("range_start"), F.lit(None).cast("long").alias("range_end"))


def fuse(facts: Facts, dfg: tuple[DataFrame, DataFrame] | None = None, linked: bool = True, epoch_id: int = 1, with_ast: bool = False) -> PropertyGraph:
    """The graph of all facts. ``linked``: edges end at graph ids; else at the raw ids of their function.

    ``with_ast`` adds AstNode nodes and AstParent/AstChild edges behind everything else of each file.
    """
    values, flows = dfg if dfg is not None else build_dfg(facts)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    functions = facts.cfg_nodes.select(*KEYS).distinct()
    top = dataflow.bindings(facts.symbols.filter("scope_id = 0")).select("file_id", "symbol_id")
    symbols = facts.symbols.join(top, ["file_id", "symbol_id"], "left_semi")
    row = lambda df, section, function, sub, local, kind, origin, start, end, label: df.select("file_id", F.lit(section).alias("_s"), function.alias("_f"), F.lit(sub).alias("_u"), local.alias("_l"), F.lit(kind).alias("kind"), origin.alias("origin"), start.alias("range_start"), end.alias("range_end"), label.alias("label"))
    start, end = F.col("range_start"), F.col("range_end")
    shown = F.concat(F.lit('Variable { name: "'), F.col("value.name"), F.lit('" }'))
    parts = [
        row(facts.files, 0, zero, 0, zero, "File", _origin("File", None, None), zero, zero, none),
        row(functions, 1, F.col("function_id"), 0, zero, "Function", _origin("Function", "function_id", "function_id"), zero, zero, none),
        row(facts.cfg_nodes, 1, F.col("function_id"), 1, F.col("node_id"), "CfgNode", _origin("Cfg", "function_id", "node_id"), start, end, F.col("kind")),
        row(values, 2, F.col("function_id"), 0, F.col("value_id"), "DfgValue", _origin("Dfg", "function_id", "value_id"), start, end, shown),
        row(symbols, 3, zero, 0, F.col("symbol_id"), "Symbol", _origin("Symbol", None, "symbol_id"), start, end, F.col("name")),
    ]
    if with_ast:
        parts.append(row(facts.ast, 4, zero, 0, F.col("node_id"), "AstNode", _origin("Ast", None, "node_id"), F.col("start"), F.col("end"), F.col("kind")))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    nodes = durable(dense_ids(nodes.withColumn("_h", F.substring("file_id", 1, 3)), ["_h", "file_id"], ["_s", "_f", "_u", "_l"], "id"))
    link = lambda df, section, kind, tag: df.select("file_id", F.lit(section).alias("_s"), "function_id", "seq", F.lit(kind).alias("kind"), "src", "dst", F.lit(tag).alias("_tag"))
    edges = link(facts.cfg_edges, 0, "ControlFlow", "Cfg").unionByName(link(flows, 1, "DataFlow", "Dfg"))
    if with_ast:
        tree = facts.ast.filter("parent_id IS NOT NULL").withColumn("function_id", F.lit(None).cast("long"))
        for k, (kind, a, b) in enumerate((("AstChild", "parent_id", "node_id"), ("AstParent", "node_id", "parent_id"))):
            edges = edges.unionByName(tree.select("file_id", F.lit(2 + k).alias("_s"), "function_id", F.col("node_id").alias("seq"), F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), F.lit("Ast").alias("_tag")))
    edges = dense_ids(edges.withColumn("_h", F.substring("file_id", 1, 3)), ["_h", "file_id"], ["_s", "function_id", "seq"], "id")
    if linked:
        ids = nodes.filter(F.col("origin.tag").isin("Cfg", "Dfg", "Ast")).select(F.col("origin.tag").alias("_tag"), "file_id", F.col("origin.function_id").alias("_fn"), F.col("origin.local_id").alias("_local"), F.col("id").alias("_to"))
        for side in ("src", "dst"):
            e, i = edges.alias("e"), ids.alias("i")
            same = (F.col("e._tag") == F.col("i._tag")) & (F.col("e.file_id") == F.col("i.file_id")) & F.col("e.function_id").eqNullSafe(F.col("i._fn")) & (F.col(f"e.{side}") == F.col("i._local"))
            edges = e.join(i, same).select("e.*", "i._to").withColumn(side, F.col("_to")).drop("_to")
    return PropertyGraph(
        nodes.select("id", "kind", code_of(F.col("kind"), NODE_KINDS).alias("kind_code"), "origin", "range_start", "range_end", "label"),
        durable(edges.select("id", "kind", code_of(F.col("kind"), EDGE_KINDS).alias("kind_code"), "src", "dst")),
        epoch_id,
    )


def call_edges(facts: Facts, graph: PropertyGraph) -> DataFrame:
    """(src, dst): CFG nodes whose statement calls a function of the same file by its plain name."""
    word = F.explode(F.array_distinct(F.regexp_extract_all("statement", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias("name")
    calls = facts.cfg_nodes.filter("kind = 'Statement'").select(*KEYS, "node_id", word)
    ranked = facts.symbols.filter("kind = 'Function' AND scope_id = 0").select("file_id", "name", F.row_number().over(_by_symbol()).alias("n"))
    functions = ranked.select("file_id", "name", (F.col("n") - 1).cast("long").alias("callee"))
    at = graph.nodes.filter("kind = 'CfgNode'").select(F.col("origin.file_id").alias("file_id"), F.col("origin.function_id").alias("function_id"), F.col("origin.local_id").alias("node_id"), F.col("id").alias("src"))
    to = graph.nodes.filter("kind = 'Function'").select(F.col("origin.file_id").alias("file_id"), F.col("origin.function_id").alias("callee"), F.col("id").alias("dst"))
    return calls.join(functions, ["file_id", "name"]).join(at, [*KEYS, "node_id"]).join(to, ["file_id", "callee"]).select("src", "dst").distinct()


def _by_symbol():
    from pyspark.sql import Window as W

    return W.partitionBy("file_id").orderBy("symbol_id")




def extension_edges(facts: Facts, graph: PropertyGraph, dfg: tuple[DataFrame, DataFrame], pts: DataFrame | None = None) -> DataFrame:
    """(id, kind, kind_code, src, dst): Defines, Calls and PointsTo edges, numbered on from the graph's own.

    Defines: CFG node to the value of its statement (same function and range). Calls: see ``call_edges``.
    PointsTo: ``pts(value, target)`` of a points-to analysis, without a value's own place.
    """
    cfg = graph.nodes.filter("kind = 'CfgNode' AND label = 'Statement'").select("origin.file_id", "origin.function_id", "range_start", "range_end", F.col("id").alias("src"))
    val = graph.nodes.filter("kind = 'DfgValue' AND range_end > 0").select("origin.file_id", "origin.function_id", "range_start", "range_end", F.col("id").alias("dst"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "src", "dst")
    found = named(cfg.join(val, [*KEYS, "range_start", "range_end"]), "Defines").unionByName(named(call_edges(facts, graph), "Calls"))
    if pts is not None:
        found = found.unionByName(named(pts.filter("value <> target").select(F.col("value").alias("src"), F.col("target").alias("dst")), "PointsTo"))
    start = graph.edges.count()
    coded = found.withColumns({"kind_code": code_of(F.col("kind"), EDGE_KINDS), "_range": F.floor(F.col("src") / 4096)})
    return dense_ids(coded, ["kind_code", "_range"], ["src", "dst"], "id", start).select("id", "kind", "kind_code", "src", "dst")
