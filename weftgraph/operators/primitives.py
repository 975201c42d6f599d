"""The five query primitives and the accessors, as plans over ``nodes`` and ``edges``.

Results are bags whose order columns are named in each docstring; sort at the edge of the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.model import NODE_KINDS
from weftgraph.operators.hops import Hops

#: Most hops that a reachability query takes, whatever it asks for.
MAX_HOPS = 100


def find_nodes(nodes: DataFrame, kind: str) -> DataFrame:
    """(id) of a kind; creation order is id order."""
    return nodes.filter(F.col("kind") == kind).select("id")


def follow_edge(edges: DataFrame, start: int, kind: str) -> DataFrame:
    """(edge_id, id): targets of the out-edges of ``start`` of one kind, in edge order, repeats kept."""
    return edges.filter((F.col("src") == start) & (F.col("kind") == kind)).select(F.col("id").alias("edge_id"), F.col("dst").alias("id"))


def follow_edges(starts: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """``starts(seq, id)`` followed one by one and concatenated: (seq, edge_id, id), repeats kept."""
    hop = edges.filter(F.col("kind") == kind).select(F.col("id").alias("edge_id"), "src", "dst")
    return starts.join(hop, starts["id"] == hop["src"]).select("seq", "edge_id", F.col("dst").alias("id"))


def filter_ids(ids: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows of ``ids`` whose node exists with the kind; no kind keeps all rows, even of missing nodes."""
    return ids if kind is None else ids.join(find_nodes(nodes, kind), "id", "left_semi")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose id is in ``b``: order and repeats of ``a`` stay (not SQL's INTERSECT)."""
    return a.join(b.select("id"), "id", "left_semi")


def reachable_within(edges: DataFrame, starts: DataFrame, hops: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, id, depth): breadth-first over edges of all kinds, at most ``min(hops, 100)`` deep.

    ``starts(*keys, id)`` are depth 0 even if the graph lacks them. With keys, each key searches alone.
    Edges are stored once; each level moves only its frontier (see ``Hops``): one join and one anti-join
    with what was seen, checkpointed to the shared folder. The loop ends with the first empty frontier.
    """
    cols = [*keys, "id"]
    level = durable(starts.select(*cols).distinct().withColumn("depth", F.lit(0)))
    seen, hops_of, rows = level, Hops(edges.select("src", "dst")), level.count()
    for depth in range(1, min(hops, MAX_HOPS) + 1):
        step = hops_of.step(level, "id", rows).select(*keys, F.col("dst").alias("id")).distinct()
        level = durable(step.join(seen, cols, "left_anti").withColumn("depth", F.lit(depth)))
        rows = level.count()
        if not rows:
            break
        seen = seen.unionByName(level)
    hops_of.drop()
    return seen.select(*cols, "depth")


def get_node(nodes: DataFrame, node_id: int) -> DataFrame:
    """The first row with the id."""
    return nodes.filter(F.col("id") == node_id).limit(1)


def edges_from(edges: DataFrame, node_id: int) -> DataFrame:
    return edges.filter(F.col("src") == node_id)


def edges_to(edges: DataFrame, node_id: int) -> DataFrame:
    return edges.filter(F.col("dst") == node_id)


def edges_of_kind(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("kind") == kind)


def nodes_of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree), zeros kept. Both counts come from one map-side combined aggregate."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("id"), F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"))


def graph_stats(nodes: DataFrame, kinds: tuple[str, ...] = NODE_KINDS) -> DataFrame:
    """(kind, nodes) for all kinds, also those without a node."""
    every = nodes.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return F.broadcast(every).join(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("nodes"))


def epoch_stats(nodes: DataFrame, edges: DataFrame, epoch_id: int) -> DataFrame:
    """(epoch_id, nodes, edges)."""
    n = nodes.agg(F.count("*").alias("nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges"))).select(F.lit(epoch_id).cast("long").alias("epoch_id"), "nodes", "edges")  # one row each
