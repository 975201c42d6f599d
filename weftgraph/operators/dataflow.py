"""Definitions, uses and phis of a data-flow graph; scope lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions.durable import durable, durable_by

#: Rounds whose facts are written together into one table.
COMPACT = 16


def defined_name(statement: Column, raw: bool = False) -> Column:
    """The variable that a statement defines (``let v ...`` or ``v = ...``), else null.

    ``let mut v`` defines ``v``. With ``raw`` the second word is taken whatever it is, and a statement
    with "let " anywhere is no assignment.
    """
    word = F.split(F.regexp_replace(statement, r"^\s+|\s+$", ""), r"\s+")
    second = F.when(F.lit(raw) | (F.get(word, F.lit(1)) != "mut"), F.get(word, F.lit(1))).otherwise(F.get(word, F.lit(2)))
    let = F.when(F.get(word, F.lit(0)) == "let", F.regexp_replace(second, r"[;=:]+$", ""))
    at = F.instr(statement, " = ")
    target = F.regexp_replace(F.substring(statement, F.lit(1), at - 1), r"^\s+|\s+$", "")
    assigned = F.when((at > 0) & (target != ""), target)
    is_let = F.contains(statement, F.lit("let ")) if raw else F.get(word, F.lit(0)) == "let"
    return F.when(is_let, let).otherwise(assigned)


def last_definition(rows: DataFrame, keys: list[str], order: list[str], is_def: Column, value: Column, out: str = "def_id") -> DataFrame:
    """``rows`` with the nearest earlier definition of straight-line code: an as-of join as one window."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(is_def, value), ignorenulls=True).over(before))


def reaching_definitions(nodes: DataFrame, edges: DataFrame, keys: list[str], max_rounds: int = 1000) -> DataFrame:
    """(keys, node_id, var, def_id): definitions that reach each node's entry, over branches and loops.

    ``nodes(keys, node_id, var, def_id)``: what a node defines, null if nothing. ``edges(keys, src, dst)``.
    Forward worklist: only facts that are new in a round travel on; a node that defines the variable
    itself stops them.
    """
    gen = durable(nodes.filter(F.col("var").isNotNull()).select(*keys, "node_id", "var", "def_id"))
    hop = durable_by(edges.select(*keys, "src", "dst").distinct(), *keys, "src")
    cols = [*keys, "node_id", "var", "def_id"]
    out, seen, parts = gen, None, 0
    for _ in range(max_rounds):
        arrive = out.withColumnRenamed("node_id", "src").join(hop, [*keys, "src"]).select(*keys, F.col("dst").alias("node_id"), "var", "def_id").distinct()
        new = durable(arrive if seen is None else arrive.join(seen, cols, "left_anti"))
        if new.isEmpty():
            break
        parts += 1  # facts are appended by round and written together now and then
        seen = new if seen is None else seen.union(new) if parts % COMPACT else durable(seen.union(new))
        out = new.join(gen.select(*keys, "node_id", "var"), [*keys, "node_id", "var"], "left_anti")
    else:
        raise RuntimeError("reaching definitions did not settle")
    return gen.limit(0) if seen is None else seen


def phi_values(reaching: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, var, defs): a phi where two or more definitions reach a merge of two predecessors.

    ``merges(keys, node_id)``; ``defs`` are the distinct definitions in order, one phi edge each.
    """
    at = reaching.join(merges, [*keys, "node_id"], "left_semi")
    return at.groupBy(*keys, "node_id", "var").agg(F.array_sort(F.collect_set("def_id")).alias("defs")).filter(F.size("defs") >= 2)


def merge_nodes(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id): Merge nodes with at least two incoming edges."""
    many = edges.groupBy(*keys, F.col("dst").alias("node_id")).agg(F.count("*").alias("n")).filter("n >= 2")
    return nodes.filter(F.col("kind") == "Merge").join(many, [*keys, "node_id"], "left_semi").select(*keys, "node_id")


def bindings(symbols: DataFrame) -> DataFrame:
    """(file_id, scope_id, name, symbol_id): the latest symbol of a name in a scope."""
    return symbols.groupBy("file_id", "scope_id", "name").agg(F.max("symbol_id").alias("symbol_id"))


def scope_chain(scopes: DataFrame, max_depth: int = 200) -> DataFrame:
    """(file_id, scope_id, ancestor, hops): each scope with itself and all its ancestors."""
    level = chain = durable(scopes.select("file_id", "scope_id", F.col("scope_id").alias("ancestor"), F.lit(0).alias("hops")))
    up = scopes.select("file_id", F.col("scope_id").alias("ancestor"), F.col("parent_id").alias("parent"))
    for hops in range(1, max_depth + 1):
        step = level.join(up, ["file_id", "ancestor"]).filter(F.col("parent").isNotNull())
        level = durable(step.select("file_id", "scope_id", F.col("parent").alias("ancestor"), F.lit(hops).alias("hops")))
        if level.isEmpty():
            return chain
        chain = chain.union(level)
    raise RuntimeError(f"scopes are nested over {max_depth} deep, or in a cycle")


def lookup(names: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``names(file_id, scope_id, name)`` with the innermost visible ``symbol_id``, null if none."""
    bound = bindings(symbols).withColumnRenamed("scope_id", "ancestor")
    hit = names.distinct().join(scope_chain(scopes), ["file_id", "scope_id"]).join(bound, ["file_id", "ancestor", "name"])
    best = hit.groupBy("file_id", "scope_id", "name").agg(F.min_by("symbol_id", "hops").alias("symbol_id"))
    return names.join(best, ["file_id", "scope_id", "name"], "left")
