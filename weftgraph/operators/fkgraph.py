"""A property graph over ordinary relational tables: rows are nodes, foreign keys are edges.

Ids are ``code * 10**10 + key``. Edge ids are ranks by (kind, src, dst), from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ordering import dense_ids
from weftgraph.model import PropertyGraph

BASE = 10**10
# Table, key column and id code of each node kind.
KINDS = {"region": ("r_regionkey", 1), "nation": ("n_nationkey", 2), "customer": ("c_custkey", 3), "supplier": ("s_suppkey", 4), "part": ("p_partkey", 5), "order": ("o_orderkey", 6)}
EDGE_KINDS = ("contains", "places", "supplies", "uses")
#: Width of the ranges of source keys within which edges are ranked together.
RANGE = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def node_id(kind: str, key: Column) -> Column:
    return (F.lit(KINDS[kind][1] * BASE) + key).cast("long")


def fk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind) of all six tables."""
    parts = [read(spark, sf_dir, "orders" if k == "order" else k).select(node_id(k, F.col(key)).alias("id"), F.lit(k).alias("kind")) for k, (key, _) in KINDS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_links(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(kind, src, dst) of the asked kinds (all by default). Order-part and part-supplier pairs are distinct."""
    lines = read(spark, sf_dir, "lineitem")
    link = lambda table, a, x, b, y, kind: (table if isinstance(table, DataFrame) else read(spark, sf_dir, table)).select(F.lit(kind).alias("kind"), node_id(a, F.col(x)).alias("src"), node_id(b, F.col(y)).alias("dst"))
    made = {
        "contains": lambda: [link("nation", "region", "n_regionkey", "nation", "n_nationkey", "contains"), link("customer", "nation", "c_nationkey", "customer", "c_custkey", "contains"), link("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "contains")],
        "places": lambda: [link("orders", "customer", "o_custkey", "order", "o_orderkey", "places")],
        "supplies": lambda: [link(lines, "supplier", "l_suppkey", "part", "l_partkey", "supplies").distinct()],
        "uses": lambda: [link(lines, "order", "l_orderkey", "part", "l_partkey", "uses").distinct()],
    }
    parts = [p for k in kinds or EDGE_KINDS for p in made[k]()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, src, dst) with dense ids over all kinds."""
    links = fk_links(spark, sf_dir).withColumn("_range", F.floor(F.col("src") / RANGE))
    return dense_ids(links, ["kind", "_range"], ["src", "dst"], "id").select("id", "kind", "src", "dst")


def fk_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(fk_nodes(spark, sf_dir), fk_edges(spark, sf_dir))
