"""The graph queries over the relational test tables, by name, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import hashing as H
from weftgraph.functions.metrics import large_time_stats
from weftgraph.functions.ordering import dense_ids, joined_list
from weftgraph.model import EDGE_KINDS, NODE_KINDS, PropertyGraph, code_of
from weftgraph.operators import changes, dataflow, fkgraph, fusion, indices, paths, points_to, taint
from weftgraph.operators import primitives as P
from weftgraph.operators.semantic import SemanticEpoch
from weftgraph.operators.fkgraph import BASE, fk_edges, fk_graph, fk_links, fk_nodes, node_id, read
from weftgraph.plans.cost import cost
from weftgraph.plans.tasks import ExecutionPlan, Filter, FindNodes, FollowEdges, Stage, Task
from weftgraph.sources import rust

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GRAPH_SQL = """
nodes AS (
  SELECT CAST(10000000000 + r_regionkey AS BIGINT) AS id, 'region' AS kind FROM region UNION ALL SELECT 20000000000 + n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 30000000000 + c_custkey, 'customer' FROM customer UNION ALL SELECT 40000000000 + s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 50000000000 + p_partkey, 'part' FROM part UNION ALL SELECT 60000000000 + o_orderkey, 'order' FROM orders),
links AS (
  SELECT 'contains' AS kind, CAST(10000000000 + n_regionkey AS BIGINT) AS src, CAST(20000000000 + n_nationkey AS BIGINT) AS dst FROM nation
  UNION ALL SELECT 'contains', 20000000000 + c_nationkey, 30000000000 + c_custkey FROM customer
  UNION ALL SELECT 'contains', 20000000000 + s_nationkey, 40000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'places', 30000000000 + o_custkey, 60000000000 + o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'supplies', 40000000000 + l_suppkey, 50000000000 + l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'uses', 60000000000 + l_orderkey, 50000000000 + l_partkey FROM lineitem),
edges AS (SELECT row_number() OVER (ORDER BY kind, src, dst) - 1 AS id, kind, src, dst FROM links)
"""
CHAIN_SQL = "c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def query(sql: str | None = None):
    """Registers a query under its function's name; ``@GRAPH`` stands for the foreign-key graph."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("@GRAPH", GRAPH_SQL).replace("@CHAIN", CHAIN_SQL)
        return f

    return add


# --- primitives and accessors ---------------------------------------------------------------------


@query("WITH @GRAPH SELECT id FROM nodes WHERE kind = 'customer'")
def find_nodes_kind(spark, sf_dir):
    return P.find_nodes(fk_nodes(spark, sf_dir), "customer")


@query("WITH @GRAPH SELECT id AS edge_id, dst AS id FROM edges WHERE src = 20000000007 AND kind = 'contains'")
def follow_edge_single(spark, sf_dir):
    return P.follow_edge(fk_edges(spark, sf_dir), 2 * BASE + 7, "contains")


@query("""WITH c AS MATERIALIZED (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1), o AS MATERIALIZED (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey),
u AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT 50000000000 + l_partkey AS id FROM o JOIN u ON l_orderkey = o_orderkey""")
def follow_edges_multi(spark, sf_dir):
    e = fk_links(spark, sf_dir).withColumn("id", F.lit(0).cast("long"))
    ids = spark.createDataFrame([(0, BASE + 1)], "seq long, id long")
    for kind in ("contains", "contains", "places", "uses"):
        ids = P.follow_edges(ids, e, kind).select(F.col("id").alias("seq"), "id")
    return ids.select("id")


@query("""WITH @GRAPH, ids AS (SELECT id FROM nodes UNION ALL SELECT id FROM nodes WHERE kind IN ('part', 'region') UNION ALL SELECT 90000000000 + r_regionkey FROM region)
SELECT id FROM ids WHERE id IN (SELECT id FROM nodes WHERE kind = 'part')""")
def filter_kind(spark, sf_dir):
    """The ids of all nodes, parts and regions twice, and some of no node."""
    n = fk_nodes(spark, sf_dir)
    ids = n.select("id").union(n.filter(F.col("kind").isin("part", "region")).select("id")).union(read(spark, sf_dir, "region").select((9 * BASE + F.col("r_regionkey")).alias("id")))
    return P.filter_ids(ids, n, "part")


@query("""WITH o AS MATERIALIZED (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'), u AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
a AS MATERIALIZED (SELECT l_partkey FROM o JOIN u ON l_orderkey = o_orderkey), s AS MATERIALIZED (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2),
b AS MATERIALIZED (SELECT DISTINCT l_partkey FROM lineitem JOIN s ON l_suppkey = s_suppkey)
SELECT 50000000000 + a.l_partkey AS id FROM a JOIN b USING (l_partkey)""")
def intersect_nodes(spark, sf_dir):
    e = fk_links(spark, sf_dir, "places", "supplies", "uses")
    buyers = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(node_id("customer", F.col("c_custkey")).alias("id"))
    near = read(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    sellers = read(spark, sf_dir, "supplier").join(near, "s_nationkey", "left_semi").select(node_id("supplier", F.col("s_suppkey")).alias("id"))
    hop = lambda ids, kind: ids.join(P.edges_of_kind(e, kind), F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
    return P.intersect(hop(hop(buyers, "places"), "uses"), hop(sellers, "supplies"))


@query("""WITH @GRAPH, o AS (SELECT src AS id, count(*) AS n FROM links GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM links GROUP BY 1)
SELECT nodes.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def edges_in_out_degree(spark, sf_dir):
    return P.degrees(fk_nodes(spark, sf_dir), fk_links(spark, sf_dir))


@query("WITH @GRAPH SELECT id, src, dst FROM edges WHERE kind = 'supplies'")
def edges_of_kind(spark, sf_dir):
    return P.edges_of_kind(fk_edges(spark, sf_dir), "supplies").select("id", "src", "dst")


@query("WITH @GRAPH SELECT 'from' AS side, id, src, dst, kind FROM edges WHERE src = 20000000003 UNION ALL SELECT 'to', id, src, dst, kind FROM edges WHERE dst = 20000000003")
def edges_of_node(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "id", "src", "dst", "kind")
    return side(P.edges_from(e, 2 * BASE + 3), "from").union(side(P.edges_to(e, 2 * BASE + 3), "to"))


@query("WITH @GRAPH SELECT id, kind FROM nodes WHERE id = 20000000003")
def get_node(spark, sf_dir):
    return P.get_node(fk_nodes(spark, sf_dir), 2 * BASE + 3)


REACH_SQL = """WITH RECURSIVE @GRAPH, r(id, depth) AS (SELECT CAST(10000000000 AS BIGINT), 0 UNION SELECT l.dst, r.depth + 1 FROM r JOIN links l ON l.src = r.id WHERE r.depth < 4)
SELECT id, min(depth) AS depth FROM r GROUP BY id"""


@query(REACH_SQL)
def reachable_within(spark, sf_dir):
    return P.reachable_within(fk_links(spark, sf_dir), spark.createDataFrame([(BASE,)], "id long"), 4)


def _chain(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(edges, first events) of the chains of a user's events in time order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst"), F.row_number().over(w).alias("k"))
    return e.filter("dst IS NOT NULL").select(F.col("src").alias("id"), "src", "dst", F.lit("DataFlow").alias("kind")), e.filter("k = 1").select("user_id", F.col("src").alias("id"))


@query("WITH @CHAIN SELECT user_id, count(*) AS nodes, CAST(max(k) - 1 AS INTEGER) AS max_depth FROM c WHERE k <= 11 GROUP BY user_id")
def reachable_capped(spark, sf_dir):
    e, first = _chain(spark, sf_dir)
    return P.reachable_within(e, first, 10, ("user_id",)).groupBy("user_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))


@query("WITH @GRAPH, k AS (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'order', 'warehouse']) AS kind) SELECT k.kind, count(nodes.id) AS nodes FROM k LEFT JOIN nodes USING (kind) GROUP BY k.kind")
def graph_stats(spark, sf_dir):
    return P.graph_stats(fk_nodes(spark, sf_dir), (*fkgraph.KINDS, "warehouse"))


@query("WITH @GRAPH SELECT CAST(7 AS BIGINT) AS epoch_id, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM links) AS edges")
def epoch_stats(spark, sf_dir):
    return P.epoch_stats(fk_nodes(spark, sf_dir), fk_links(spark, sf_dir), 7)


# --- indices --------------------------------------------------------------------------------------


@query("WITH @GRAPH SELECT src, kind, count(*) AS n, min(id) AS first_edge, max(id) AS last_edge, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS list_sha256 FROM edges GROUP BY src, kind")
def index_node_edges(spark, sf_dir):
    i = indices.node_edges(fk_edges(spark, sf_dir))
    ids = F.col("edge_ids")
    return i.select("src", "kind", F.size(ids).cast("long").alias("n"), F.array_min(ids).alias("first_edge"), F.array_max(ids).alias("last_edge"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("list_sha256"))


@query("WITH @GRAPH SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY id) AS callers FROM edges WHERE kind = 'supplies' GROUP BY dst")
def index_func_calls(spark, sf_dir):
    g = fk_graph(spark, sf_dir)
    return indices.func_calls(g.nodes, g.edges, "supplies", "part").select("id", F.array_join(F.col("callers").cast("array<string>"), ",").alias("callers"))


def _as_values(nodes: DataFrame, kind: str, tag: str) -> DataFrame:
    """Nodes of the foreign-key graph dressed as nodes of a code graph."""
    key = (F.col("id") % BASE).alias("local_id")
    origin = F.struct(F.lit(tag).alias("tag"), F.lit("0").alias("file_id"), F.lit(0).cast("long").alias("function_id"), key)
    return nodes.select("id", F.lit(kind).alias("kind"), origin.alias("origin"))


@query("WITH @GRAPH SELECT CAST(dst - 50000000000 AS BIGINT) AS value_id, count(*) AS n, string_agg(CAST(src AS VARCHAR), ',' ORDER BY id) AS uses FROM edges WHERE kind = 'uses' GROUP BY dst")
def index_var_uses(spark, sf_dir):
    g = fk_graph(spark, sf_dir)
    values = _as_values(P.nodes_of_kind(g.nodes, "part"), "DfgValue", "Dfg")
    flow = P.edges_of_kind(g.edges, "uses").withColumn("kind", F.lit("DataFlow"))
    return indices.var_uses(values, flow).select("value_id", F.size("uses").cast("long").alias("n"), F.array_join(F.col("uses").cast("array<string>"), ",").alias("uses"))


@query("WITH n AS (SELECT 20000000000 + n_nationkey AS id, n_regionkey AS symbol_id FROM nation) SELECT CAST(symbol_id AS BIGINT) AS symbol_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS node_ids FROM n GROUP BY symbol_id")
def index_symbol_defs(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    origin = F.struct(F.lit("Symbol").alias("tag"), F.lit("0").alias("file_id"), F.col("n_regionkey").cast("long").alias("local_id"))
    nodes = n.select(node_id("nation", F.col("n_nationkey")).alias("id"), F.lit("Symbol").alias("kind"), origin.alias("origin"))
    return indices.symbol_defs(nodes).select("symbol_id", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"))


# --- control-flow graphs and fingerprints ---------------------------------------------------------


def _turns(spark, sf_dir) -> DataFrame:
    """Conversations as functions, turns as statements, with ranges of running character offsets."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    end = F.sum("n").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return t.select("conv_id", "turn", (end - F.col("n")).alias("range_start"), end.alias("range_end"))


def _conversation_cfg(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) per conversation with local ids: Entry 0, Exit 1, turn k at 2 + k."""
    t = _turns(spark, sf_dir)
    ends = t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("range_end").alias("range_end"))
    frame = ends.select("conv_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("node_id"), F.lit("Entry").alias("kind")), F.struct(F.lit(1).cast("long").alias("node_id"), F.lit("Exit").alias("kind")))).alias("x"), F.lit(0).cast("long").alias("range_start"), "range_end")
    nodes = frame.select("conv_id", "x.node_id", "x.kind", "range_start", "range_end").unionByName(t.select("conv_id", (F.col("turn") + 2).cast("long").alias("node_id"), F.lit("Statement").alias("kind"), "range_start", "range_end"))
    # One edge into each turn, and one from the last turn to Exit.
    inner = t.select("conv_id", F.col("turn").cast("long").alias("seq"), F.when(F.col("turn") == 0, 0).otherwise(F.col("turn") + 1).cast("long").alias("src"), (F.col("turn") + 2).cast("long").alias("dst"))
    last = ends.select("conv_id", F.col("turns").alias("seq"), (F.col("turns") + 1).alias("src"), F.lit(1).cast("long").alias("dst"))
    return nodes, inner.unionByName(last).withColumn("kind", F.lit("Normal"))


CFG_SQL = """t AS (SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) - length(coalesce(text, '')) AS BIGINT) AS rs, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS re FROM conversations),
z AS (SELECT conv_id, count(*) AS turns, max(re) AS re FROM t GROUP BY conv_id),
n AS (SELECT conv_id, CAST(0 AS BIGINT) AS node_id, 'Entry' AS kind, CAST(0 AS BIGINT) AS rs, re FROM z UNION ALL SELECT conv_id, 1, 'Exit', 0, re FROM z UNION ALL SELECT conv_id, turn + 2, 'Statement', rs, re FROM t),
e AS (SELECT conv_id, CAST(turn AS BIGINT) AS seq, CAST(CASE WHEN turn = 0 THEN 0 ELSE turn + 1 END AS BIGINT) AS src, CAST(turn + 2 AS BIGINT) AS dst FROM t UNION ALL SELECT conv_id, turns, turns + 1, 1 FROM z)"""


@query(f"""WITH {CFG_SQL}, o AS (SELECT conv_id, CAST(coalesce(sum(turns + 2) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM z)
SELECT conv_id, 'node' AS what, base + node_id AS a, CAST(NULL AS BIGINT) AS b, kind FROM n JOIN o USING (conv_id) UNION ALL SELECT conv_id, 'edge', base + src, base + dst, 'Normal' FROM e JOIN o USING (conv_id)""")
def cfg_from_conversations(spark, sf_dir):
    nodes, edges = _conversation_cfg(spark, sf_dir)
    numbered = dense_ids(nodes, ["conv_id"], ["node_id"], "a")
    base = numbered.filter("node_id = 0").select("conv_id", F.col("a").alias("base"))
    flow = edges.join(base, "conv_id").select("conv_id", F.lit("edge").alias("what"), (F.col("base") + F.col("src")).alias("a"), (F.col("base") + F.col("dst")).alias("b"), "kind")
    return numbered.select("conv_id", F.lit("node").alias("what"), "a", F.lit(None).cast("long").alias("b"), "kind").unionByName(flow)


BE = "lpad(lower(hex(CAST({} AS BIGINT))), 16, '0')"


def _le(x: str) -> str:
    h = BE.format(x)
    return " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2))


@query(f"""WITH {CFG_SQL}, a AS (SELECT conv_id, string_agg({BE.format('node_id')} || lower(hex(encode(kind))), '' ORDER BY node_id) AS s FROM n GROUP BY conv_id),
b AS (SELECT conv_id, string_agg({BE.format('src')} || {BE.format('dst')} || lower(hex(encode('Normal'))), '' ORDER BY seq) AS s FROM e GROUP BY conv_id)
SELECT conv_id, sha256(unhex({BE.format('conv_id')} || a.s || b.s)) AS cfg_hash FROM a JOIN b USING (conv_id)""")
def cfg_hash(spark, sf_dir):
    nodes, edges = _conversation_cfg(spark, sf_dir)
    return H.cfg_hashes(nodes, edges, "conv_id")


@query(f"""WITH {CFG_SQL}, g AS (SELECT conv_id, CAST(0 AS BIGINT) AS id, 4 AS k, CAST(0 AS BIGINT) AS rs, CAST(0 AS BIGINT) AS re FROM z UNION ALL SELECT conv_id, node_id + 1, 1, rs, re FROM n),
a AS (SELECT conv_id, {_le('count(*)')} || string_agg({_le('id')} || lpad(lower(hex(k)), 2, '0') || {_le('rs')} || {_le('re')}, '' ORDER BY id) AS s FROM g GROUP BY conv_id),
b AS (SELECT conv_id, {_le('count(*)')} || string_agg({_le('seq')} || '02' || {_le('src + 1')} || {_le('dst + 1')}, '' ORDER BY seq) AS s FROM e GROUP BY conv_id)
SELECT conv_id, sha256(unhex(a.s || b.s)) AS graph_hash FROM a JOIN b USING (conv_id)""")
def graph_hash(spark, sf_dir):
    """A graph per conversation: its Function node and its CfgNodes, linked by ControlFlow."""
    nodes, edges = _conversation_cfg(spark, sf_dir)
    zero = F.lit(0).cast("long")
    g = nodes.select("conv_id", (F.col("node_id") + 1).alias("id"), F.lit("CfgNode").alias("kind"), "range_start", "range_end").unionByName(nodes.filter("node_id = 0").select("conv_id", zero.alias("id"), F.lit("Function").alias("kind"), zero.alias("range_start"), zero.alias("range_end")))
    e = edges.select("conv_id", F.col("seq").alias("id"), F.lit("ControlFlow").alias("kind"), (F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    part = lambda df, row: df.groupBy("conv_id").agg(F.concat(H.le64(F.count("*")), joined_list(F.col("id"), row, "")).alias("s"))
    a, b = part(g, H.node_bytes(code_of(F.col("kind"), NODE_KINDS))), part(e, H.edge_bytes(code_of(F.col("kind"), EDGE_KINDS)))
    return a.join(b.withColumnRenamed("s", "t"), "conv_id").select("conv_id", H.sha256_of_hex(F.concat("s", "t")).alias("graph_hash"))


# --- repository snapshots, changes, invalidation --------------------------------------------------


@query("SELECT substr(sha256(url), 1, 16) AS file_id, url AS path, CASE WHEN regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) = 'rs' THEN 'Rust' END AS language, row_number() OVER (ORDER BY substr(sha256(url), 1, 16)) - 1 AS position FROM pages")
def file_ids(spark, sf_dir):
    f = read(spark, sf_dir, "pages").select(H.file_id(F.col("url")).alias("file_id"), F.col("url").alias("path"))
    f = f.withColumn("language", F.when(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1) == "rs", "Rust")).withColumn("_head", F.substring("file_id", 1, 3))
    return dense_ids(f, ["_head"], ["file_id"], "position").select("file_id", "path", "language", "position")


@query(f"""WITH f AS (SELECT source, CAST(doc_id AS VARCHAR) AS path, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS h FROM documents)
SELECT source, sha256(unhex(string_agg(substr(sha256(path), 1, 16) || lower(hex(encode(path))) || {BE.format('size')} || lower(hex(encode(h))), '' ORDER BY substr(sha256(path), 1, 16)))) AS snapshot_hash FROM f GROUP BY source""")
def snapshot_hash(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    f = read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.octet_length(text).alias("size"), H.content_hash(text).alias("content_hash"))
    return H.snapshot_hashes(f, "source")


def _two_snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fid = H.file_id(F.col("doc_id").cast("string")).alias("file_id")
    now = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return d.filter("doc_id % 10 <> 0").select(fid, H.content_hash(F.col("text")).alias("content_hash")), d.filter("doc_id % 10 <> 1").select(fid, H.content_hash(now).alias("content_hash"))


SNAP_SQL = """p AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS file_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 10 <> 0),
c AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS file_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 10 <> 1)"""


@query(f"WITH {SNAP_SQL} SELECT coalesce(p.file_id, c.file_id) AS file_id, CASE WHEN p.h IS NULL THEN 'Added' WHEN c.h IS NULL THEN 'Deleted' WHEN p.h = c.h THEN 'Unchanged' ELSE 'Modified' END AS change FROM p FULL JOIN c ON p.file_id = c.file_id")
def change_detect(spark, sf_dir):
    return changes.detect_changes(*_two_snapshots(spark, sf_dir))


@query(f"WITH {SNAP_SQL} SELECT c.file_id FROM c LEFT JOIN p ON p.file_id = c.file_id AND p.h = c.h WHERE p.h IS NULL")
def tree_cache_misses(spark, sf_dir):
    return changes.reparse_set(*_two_snapshots(spark, sf_dir))


def _changed_windows(turns: DataFrame) -> DataFrame:
    """Of each conversation the characters [100, 300) and, where it is long enough, [1000, 1001)."""
    w = F.explode(F.array(F.struct(F.lit(100).cast("long").alias("start"), F.lit(300).cast("long").alias("end")), F.struct(F.lit(1000).cast("long").alias("start"), F.lit(1001).cast("long").alias("end"))))
    return turns.select("conv_id").distinct().select("conv_id", w.alias("w")).select("conv_id", "w.start", "w.end")


INVALID_SQL = f"{CFG_SQL}, w(ws, we) AS (VALUES (100, 300), (1000, 1001)), hit AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS node_id FROM t, w WHERE (re > ws AND we > rs) OR (rs = ws AND re = we))"


@query(f"WITH {INVALID_SQL} SELECT * FROM hit")
def invalidate_ranges(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return changes.invalidated_nodes(t.withColumn("node_id", F.col("turn").cast("long")), _changed_windows(t), ["conv_id"])


@query(f"WITH {INVALID_SQL}, d AS (SELECT conv_id, CAST(turn AS BIGINT) AS node_id, CAST(turn AS BIGINT) AS edge_id FROM t UNION ALL SELECT conv_id, turn, turn + 1 FROM t) SELECT DISTINCT conv_id, edge_id FROM hit JOIN d USING (conv_id, node_id)")
def invalidate_dfg(spark, sf_dir):
    t = _turns(spark, sf_dir)
    k = F.col("turn").cast("long")
    tracked = t.select("conv_id", k.alias("node_id"), F.explode(F.array(k, k + 1)).alias("edge_id"))
    hit = changes.invalidated_nodes(t.withColumn("node_id", k), _changed_windows(t), ["conv_id"])
    return changes.invalidated_edges(hit, tracked, ["conv_id"])


# --- bounded analyses -----------------------------------------------------------------------------


def _taint(spark, sf_dir) -> taint.TaintResult:
    src = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("source"), F.lit("ExternalInput").alias("kind"), node_id("customer", F.col("c_custkey")).alias("node"))
    sink = read(spark, sf_dir, "part").filter("p_size <= 5").select(F.lit("FunctionCall").alias("kind"), node_id("part", F.col("p_partkey")).alias("node"))
    return taint.analyze(fk_edges(spark, sf_dir), src, sink, ("places", "uses"))


@query("""WITH @GRAPH, p AS (SELECT a.src AS source_id, b.dst AS sink_id, a.id || ',' || b.id AS edge_path, a.src || ',' || a.dst || ',' || b.dst AS node_path, row_number() OVER (PARTITION BY a.src, b.dst ORDER BY a.id, b.id) AS rn
FROM customer JOIN edges a ON a.src = 30000000000 + c_custkey AND a.kind = 'places' JOIN edges b ON b.src = a.dst AND b.kind = 'uses' JOIN part ON b.dst = 50000000000 + p_partkey AND p_size <= 5 WHERE c_acctbal < 0)
SELECT source_id, sink_id, 2 AS depth, edge_path, node_path FROM p WHERE rn = 1""")
def taint_paths(spark, sf_dir):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _taint(spark, sf_dir).paths.select("source_id", "sink_id", "depth", text("edge_path"), text("node_path"))


@query("""WITH @GRAPH, s AS (SELECT 30000000000 + c_custkey AS id FROM customer WHERE c_acctbal < 0), o AS (SELECT dst AS id FROM links JOIN s ON src = s.id AND kind = 'places'), p AS (SELECT dst AS id FROM links JOIN o ON src = o.id AND kind = 'uses')
SELECT id AS node FROM s UNION SELECT id FROM o UNION SELECT id FROM p""")
def taint_tainted(spark, sf_dir):
    return _taint(spark, sf_dir).tainted()


@query("""WITH @CHAIN, t AS (SELECT user_id, least(max(n), 50) AS tainted FROM c GROUP BY user_id), h AS (SELECT user_id, count(*) AS hits, CAST(max(k) - 1 AS INTEGER) AS deepest FROM c WHERE k IN (2, 25, 50, 51, 60) AND k <= 50 GROUP BY user_id)
SELECT user_id, tainted, coalesce(hits, 0) AS hits, deepest FROM t LEFT JOIN h USING (user_id)""")
def taint_depth_cap(spark, sf_dir):
    """Taint along each user's chain of events, from the first, with sinks on both sides of the depth cap."""
    e, first = _chain(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    at = read(spark, sf_dir, "events").select("event_id", place.alias("k"))
    sinks = at.filter(F.col("k").isin(2, 25, 50, 51, 60)).select(F.lit("Return").alias("kind"), F.col("event_id").alias("node"))
    found = taint.analyze(e, first.select(F.col("user_id").alias("source"), F.lit("Parameter").alias("kind"), F.col("id").alias("node")), sinks)
    hits = found.paths.groupBy("source").agg(F.count("*").alias("hits"), F.max("depth").alias("deepest"))
    return found.visited.groupBy("source").agg(F.count("*").alias("tainted")).join(hits, "source", "left").select(F.col("source").alias("user_id"), "tainted", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "deepest")


@query("WITH @GRAPH SELECT p.id AS value, 1 + count(l.src) AS n_targets, FALSE AS is_unknown FROM nodes p LEFT JOIN links l ON l.dst = p.id AND l.kind = 'supplies' WHERE p.kind IN ('part', 'supplier') GROUP BY p.id")
def points_to_seeded(spark, sf_dir):
    values = fk_nodes(spark, sf_dir).filter(F.col("kind").isin("supplier", "part")).select(F.col("id").alias("value"))
    return points_to.analyze(values, fk_links(spark, sf_dir, "supplies"), "self").sets()


OVERFLOW_SQL = """x AS (SELECT dst AS src, src AS dst FROM links WHERE kind = 'supplies' UNION ALL SELECT dst, src FROM links WHERE kind = 'contains' AND dst BETWEEN 30000000000 AND 39999999999),
v AS (SELECT id, 1 + (SELECT count(*) FROM x WHERE x.dst = nodes.id) AS n FROM nodes WHERE kind IN ('part', 'supplier', 'customer', 'nation'))"""


def _overflow(spark, sf_dir) -> points_to.PointsTo:
    values = fk_nodes(spark, sf_dir).filter(F.col("kind").isin("supplier", "part", "customer", "nation")).select(F.col("id").alias("value"))
    lives = F.col("dst").between(3 * BASE, 4 * BASE - 1)
    e = fk_links(spark, sf_dir, "supplies").union(fk_links(spark, sf_dir, "contains").filter(lives)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return points_to.analyze(values, e, "self")


@query(f"WITH @GRAPH, {OVERFLOW_SQL} SELECT id AS value, CASE WHEN n <= 100 THEN n END AS n_targets, n > 100 AS is_unknown FROM v")
def points_to_overflow(spark, sf_dir):
    return _overflow(spark, sf_dir).sets()


@query(f"WITH @GRAPH, {OVERFLOW_SQL} SELECT count(*) AS analyzed, count(*) FILTER (WHERE n <= 100) AS known, count(*) FILTER (WHERE n > 100) AS \"unknown\", CAST(sum(CASE WHEN n <= 100 THEN n ELSE 0 END) AS BIGINT) AS points_to_edges, max(n) <= 100 AS completed FROM v")
def points_to_stats(spark, sf_dir):
    return _overflow(spark, sf_dir).stats()


@query("WITH e AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM events) SELECT user_id, event_id, def_id FROM e WHERE event_type = 'view'")
def reaching_def(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    seen = dataflow.last_definition(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"))
    return seen.filter("event_type = 'view'").select("user_id", "event_id", "def_id")


@query("WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT l_orderkey AS node_id, count(*) AS phi_edges, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS defs FROM d GROUP BY l_orderkey HAVING count(*) >= 2")
def phi_merge(spark, sf_dir):
    """Suppliers as definitions of one variable that meet in an order."""
    reach = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.lit("v").alias("var"), F.col("l_suppkey").alias("def_id")).distinct()
    phis = dataflow.phi_values(reach, reach.select("node_id"), [])
    return phis.select("node_id", F.size("defs").cast("long").alias("phi_edges"), F.array_join(F.col("defs").cast("array<string>"), ",").alias("defs"))


@query("""SELECT c_custkey AS customer, CASE WHEN c_custkey % 3 = 0 THEN 30000000000 + c_custkey WHEN c_nationkey % 2 = 0 THEN 20000000000 + c_nationkey ELSE 10000000000 + n_regionkey END AS symbol_id
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def scope_lookup(spark, sf_dir):
    """One name, bound in every region, in even nations and in every third customer; looked up from customers."""
    nation, customer, region = (read(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    scope = lambda df, kind, key, up, upkey: df.select(F.lit("f").alias("file_id"), node_id(kind, F.col(key)).alias("scope_id"), (node_id(up, F.col(upkey)) if up else F.lit(None).cast("long")).alias("parent_id"))
    scopes = scope(region, "region", "r_regionkey", None, None).union(scope(nation, "nation", "n_nationkey", "region", "n_regionkey")).union(scope(customer, "customer", "c_custkey", "nation", "c_nationkey"))
    key = F.col("scope_id") % BASE
    bound = F.col("parent_id").isNull() | ((F.floor(F.col("scope_id") / BASE) == 2) & (key % 2 == 0)) | ((F.floor(F.col("scope_id") / BASE) == 3) & (key % 3 == 0))
    symbols = scopes.filter(bound).select("file_id", "scope_id", F.lit("tax").alias("name"), F.col("scope_id").alias("symbol_id"))
    names = customer.select(F.lit("f").alias("file_id"), node_id("customer", F.col("c_custkey")).alias("scope_id"), F.lit("tax").alias("name"))
    return dataflow.lookup(names, scopes, symbols).select((F.col("scope_id") % BASE).alias("customer"), "symbol_id")


# --- plans, metrics, text -------------------------------------------------------------------------


@query("""WITH @GRAPH, r AS (SELECT 1 AS task_id, 0 AS "commit", id AS a, 0 AS b, id FROM nodes WHERE kind = 'region'
UNION ALL SELECT 2, 1, x.seq, edges.id, edges.dst FROM (VALUES (0, 20000000004), (1, 20000000001), (2, 20000000004)) x(seq, start) JOIN edges ON edges.src = x.start AND edges.kind = 'contains'
UNION ALL SELECT 3, 2, x.seq, 0, x.id FROM (VALUES (0, 20000000001), (1, 77), (2, 30000000001), (3, 20000000001)) x(seq, id) WHERE x.id IN (SELECT id FROM nodes WHERE kind = 'nation'))
SELECT row_number() OVER (ORDER BY "commit", a, b) - 1 AS position, CAST(task_id AS BIGINT) AS task_id, CAST(id AS BIGINT) AS id FROM r""")
def plan_commit_order(spark, sf_dir):
    """Three tasks inserted as 3, 1, 2 commit as 1, 2, 3."""
    g = fk_graph(spark, sf_dir)
    nation = 2 * BASE
    t = [Task(3, Filter((nation + 1, 77, 3 * BASE + 1, nation + 1), "nation"), 0), Task(1, FindNodes("region"), 1), Task(2, FollowEdges((nation + 4, nation + 1, nation + 4), "contains"), 2)]
    rows = ExecutionPlan([Stage(t)]).execute(g)
    return dense_ids(rows, ["stage", "commit", "a"], ["b"], "position").select("position", "task_id", "id")


@query("WITH @GRAPH, k AS (SELECT kind, count(*) AS n, CAST(count(*) AS DOUBLE) / count(DISTINCT src) AS fanout FROM links GROUP BY kind) SELECT kind, n AS node_count, fanout, CAST(n AS DOUBLE) * fanout * 3.0 * (1.0 - CAST(0.25 AS DOUBLE)) AS cost FROM k")
def query_cost(spark, sf_dir):
    k = fk_links(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("node_count"), F.count_distinct("src").alias("sources"))
    fanout = F.col("node_count").cast("double") / F.col("sources")
    return k.withColumn("fanout", fanout).select("kind", "node_count", "fanout", cost(F.col("node_count"), F.col("fanout"), F.lit(3), F.lit(0.25)).alias("cost"))


@query("""WITH v AS (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) AS v FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, list(v ORDER BY v) AS l FROM v GROUP BY event_type)
SELECT event_type, n, total, CAST(total // n AS BIGINT) AS mean, l[CAST(n * 50 // 100 AS BIGINT) + 1] AS p50, l[CAST(n * 95 // 100 AS BIGINT) + 1] AS p95, l[CAST(n * 99 // 100 AS BIGINT) + 1] AS p99 FROM s""")
def parse_time_stats(spark, sf_dir):
    return large_time_stats(read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("v")), "v", "event_type")


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'let v' || user_id || ' = 1;' WHEN 1 THEN 'let mut m' || user_id || ': i32 = 2;' WHEN 2 THEN 'a' || user_id || ' = b;' WHEN 3 THEN 'call(' || user_id || ');' ELSE 'let x' || user_id || ';' END AS statement FROM events)
SELECT event_id, statement, CASE event_id % 5 WHEN 0 THEN regexp_extract(statement, 'let (v[0-9]+)', 1) WHEN 1 THEN regexp_extract(statement, 'mut (m[0-9]+)', 1) WHEN 2 THEN regexp_extract(statement, '^(a[0-9]+) =', 1) WHEN 4 THEN regexp_extract(statement, 'let (x[0-9]+)', 1) END AS var FROM s""")
def extract_defs(spark, sf_dir):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 5
    s = F.when(k == 0, F.concat(F.lit("let v"), u, F.lit(" = 1;"))).when(k == 1, F.concat(F.lit("let mut m"), u, F.lit(": i32 = 2;"))).when(k == 2, F.concat(F.lit("a"), u, F.lit(" = b;"))).when(k == 3, F.concat(F.lit("call("), u, F.lit(");"))).otherwise(F.concat(F.lit("let x"), u, F.lit(";")))
    return read(spark, sf_dir, "events").select("event_id", s.alias("statement")).withColumn("var", dataflow.defined_name(F.col("statement")))


@query("""WITH @GRAPH, p AS (SELECT d.dst AS node, a.id || ',' || b.id || ',' || d.id AS edge_path, a.src || ',' || a.dst || ',' || b.dst || ',' || d.dst AS node_path, row_number() OVER (PARTITION BY d.dst ORDER BY a.id, b.id, d.id) AS rn
FROM edges a JOIN edges b ON a.dst = b.src AND b.kind = 'contains' JOIN edges d ON b.dst = d.src AND d.kind = 'supplies' WHERE a.src = 10000000000 AND a.kind = 'contains')
SELECT node, 3 AS depth, edge_path, node_path FROM p WHERE rn = 1""")
def explain_path(spark, sf_dir):
    """How region 0 leads to each part its suppliers sell: the chain a first-in-first-out search records."""
    e = fk_edges(spark, sf_dir).filter(F.col("kind").isin("contains", "supplies"))
    found = paths.explain(e, BASE, fk_nodes(spark, sf_dir).filter("kind = 'part'"), 4)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("node", "depth", text("edge_path"), text("node_path"))


# --- source code ----------------------------------------------------------------------------------


def _sources(spark, sf_dir) -> DataFrame:
    """Each conversation as a source file of one function: a ``let`` a turn, a branch before even turns."""
    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("    let t"), F.col("turn"), F.lit(" = "), F.length(F.coalesce("text", F.lit(""))), F.lit(";\n"))).otherwise(F.concat(F.lit("    if t0 > "), F.col("turn"), F.lit(" { let u = 1; }\n")))
    body = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined_list(F.col("turn"), line, "").alias("b"))
    path = F.concat(F.lit("src/c"), F.col("conv_id"), F.lit(".rs"))
    return body.select("conv_id", H.file_id(path).alias("file_id"), F.concat(F.lit("fn c"), F.col("conv_id"), F.lit("() {\n"), "b", F.lit("}\n")).cast("binary").alias("content"))


@query("""WITH t AS (SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS lets, count(*) FILTER (WHERE turn % 2 = 1) AS ifs FROM conversations GROUP BY conv_id)
SELECT conv_id, 2 + lets + 3 * ifs AS cfg_nodes, 1 + lets + 4 * ifs AS cfg_edges, 1 + lets + ifs AS symbols FROM t""")
def parsed_functions(spark, sf_dir):
    """Source text through the parser: sizes of each function's CFG and of its symbol table."""
    files = _sources(spark, sf_dir)
    facts = rust.analyze(files.select("file_id", "content"))
    count = lambda df, name: df.groupBy("file_id").agg(F.count("*").alias(name))
    joined = count(facts.cfg_nodes, "cfg_nodes").join(count(facts.cfg_edges, "cfg_edges"), "file_id").join(count(facts.symbols, "symbols"), "file_id")
    return files.select("conv_id", "file_id").join(joined, "file_id").select("conv_id", "cfg_nodes", "cfg_edges", "symbols")


@query("""WITH t AS (SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS lets, count(*) FILTER (WHERE turn % 2 = 1) AS ifs FROM conversations GROUP BY conv_id)
SELECT 'File' AS kind, count(*) AS nodes FROM t UNION ALL SELECT 'Function', count(*) FROM t UNION ALL SELECT 'CfgNode', CAST(sum(2 + lets + 3 * ifs) AS BIGINT) FROM t
UNION ALL SELECT 'DfgValue', CAST(sum(lets + ifs + greatest(ifs - 1, 0)) AS BIGINT) FROM t UNION ALL SELECT 'Symbol', count(*) FROM t UNION ALL SELECT 'AstNode', 0""")
def fused_graph_stats(spark, sf_dir):
    """Source text through parser and fusion: nodes of the code graph by kind."""
    facts = rust.analyze(_sources(spark, sf_dir).select("file_id", "content"))
    graph: PropertyGraph = fusion.fuse(facts)
    return P.graph_stats(graph.nodes)




@query("""WITH t AS (SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS lets, count(*) FILTER (WHERE turn % 2 = 1) AS ifs FROM conversations GROUP BY conv_id)
SELECT CAST(3 AS BIGINT) AS epoch_id, count(*) AS files, count(*) AS cfgs, count(*) AS dfgs, CAST(sum(1 + lets + 2 * ifs) AS BIGINT) AS tracked_ranges, CAST(sum(CASE WHEN ifs >= 2 THEN ifs ELSE 0 END) AS BIGINT) AS tracked_nodes FROM t""")
def semantic_stats(spark, sf_dir):
    """Source text through parser and data flow: sizes of the semantic epoch."""
    facts = rust.analyze(_sources(spark, sf_dir).select("file_id", "content"))
    return SemanticEpoch.build(facts, 3).stats()


from weftgraph import code_queries  # noqa: E402, F401  registers the queries over source code, snapshots and plans
