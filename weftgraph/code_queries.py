"""Queries over source code, repositories, snapshots, plans and metrics, each with its DuckDB SQL.

Programs are generated from ``conversations``, a file each; the repository has a file per nation and region.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.engine import Engine
from weftgraph.functions import hashing as H
from weftgraph.functions.durable import settings, shared_dir
from weftgraph.functions.metrics import MetricsCollector
from weftgraph.functions.ordering import dense_ids, joined_list
from weftgraph.model import PropertyGraph
from weftgraph.operators import changes, indices
from weftgraph.operators import primitives as P
from weftgraph.operators.fkgraph import BASE, fk_edges, fk_links, fk_nodes, read
from weftgraph.operators.semantic import SemanticEpoch
from weftgraph.plans.cost import PlanCache
from weftgraph.plans.json_query import compile_query
from weftgraph.plans.tasks import FindNodes, Task
from weftgraph.queries import BE, CFG_SQL, _as_values, _conversation_cfg, _le, _overflow, _sources, _turns, query
from weftgraph.sources import rust
from weftgraph.sources.recovery import RecoveryManager
from weftgraph.sources.scan import RepoScanner, snapshot_hash
from weftgraph.sources.snapshot import SnapshotError, Store, verify

# --- programs: a function with a statement a turn, and a second function ---------------------------------

LINES = (
    "    if a > 1 { let u = 1; } else { let w = 2; let x = 3; }\n",
    "    while a > 2 { step(); }\n",
    "    loop { step(); }\n",
    "    match a { 1 => one(), _ => two(), }\n",
    "    { let n = 1; { let m = 2; } }\n",
)
#: Per kind of turn (a ``let``, then the lines above): control-flow nodes, symbols and scopes that it makes.
SIZES_SQL = """t AS (SELECT conv_id, turn, turn % 6 AS k, CASE turn % 6 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 1 END AS s, CASE turn % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 5 THEN 2 ELSE 0 END AS sy, CASE turn % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS sc FROM conversations),
o AS (SELECT *, CAST(2 + coalesce(sum(s) OVER w, 0) AS BIGINT) AS o, CAST(3 + coalesce(sum(sy) OVER w, 0) AS BIGINT) AS b, CAST(3 + coalesce(sum(sc) OVER w, 0) AS BIGINT) AS c FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN k IN (0, 5) THEN o ELSE o + 1 END AS leaves FROM o),
z AS (SELECT conv_id, max(turn) AS last, CAST(2 + sum(s) AS BIGINT) AS n, CAST(3 + sum(sy) AS BIGINT) AS sy, CAST(3 + sum(sc) AS BIGINT) AS sc FROM t GROUP BY conv_id)"""


def _programs(spark, sf_dir) -> DataFrame:
    k, turn = F.col("turn") % 6, F.col("turn").cast("string")
    line = F.concat(F.lit("    let t"), turn, F.lit(" = a;\n"))
    for i, text in enumerate(LINES):
        line = F.when(k == i + 1, F.lit(text)).otherwise(line)
    body = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined_list(F.col("turn"), line, "").alias("b"))
    name = F.col("conv_id").cast("string")
    text = F.concat(F.lit("fn p"), name, F.lit("(a: i32, b: i32) {\n"), "b", F.lit("}\nfn q"), name, F.lit("(c: i32) {\n    let z = c;\n}\n"))
    return body.select("conv_id", H.file_id(F.concat(F.lit("p/"), name)).alias("file_id"), text.cast("binary").alias("content"))


def _with_conv(files: DataFrame, facts: DataFrame) -> DataFrame:
    return facts.join(files.select("conv_id", "file_id"), "file_id")


@query(f"""WITH {SIZES_SQL}, e AS (
  SELECT conv_id, 0 AS function_id, coalesce(lag(leaves) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS src, o AS dst, 'Normal' AS kind FROM f
  UNION ALL SELECT f.conv_id, 0, leaves, 1, 'Normal' FROM f JOIN z ON z.conv_id = f.conv_id AND turn = last
  UNION ALL SELECT conv_id, 0, o + x.a, o + x.b, x.kind FROM f JOIN (VALUES (1, 0, 2, 'Normal'), (1, 2, 1, 'Normal'), (1, 0, 3, 'Normal'), (1, 3, 4, 'Normal'), (1, 4, 1, 'Normal'), (2, 0, 2, 'Normal'), (2, 2, 0, 'Continue'), (2, 0, 1, 'Break'),
    (3, 0, 2, 'Normal'), (3, 2, 0, 'Continue'), (4, 0, 2, 'Normal'), (4, 2, 1, 'Normal'), (4, 0, 3, 'Normal'), (4, 3, 1, 'Normal')) x(k, a, b, kind) USING (k)
  UNION ALL SELECT conv_id, 1, n + x.a, n + x.b, 'Normal' FROM z, (VALUES (0, 2), (2, 1)) x(a, b))
SELECT conv_id, CAST(function_id AS BIGINT) AS function_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, kind FROM e""")
def cfg_edges_of_programs(spark, sf_dir):
    """Every control-flow edge of branches with else, loops, matches and blocks, over two functions a file."""
    files = _programs(spark, sf_dir)
    return _with_conv(files, rust.analyze(files.select("file_id", "content")).cfg_edges).select("conv_id", "function_id", "src", "dst", "kind")


@query(f"""WITH {SIZES_SQL} SELECT conv_id, CAST(function_id AS BIGINT) AS function_id, CAST(node_id AS BIGINT) AS node_id, kind, statement FROM (
  SELECT conv_id, 0 AS function_id, x.i AS node_id, x.kind, x.text AS statement FROM z, (VALUES (0, 'Entry', '<entry>'), (1, 'Exit', '<exit>')) x(i, kind, text)
  UNION ALL SELECT conv_id, 1, n + x.i, x.kind, x.text FROM z, (VALUES (0, 'Entry', '<entry>'), (1, 'Exit', '<exit>'), (2, 'Statement', 'let z = c;')) x(i, kind, text)
  UNION ALL SELECT conv_id, 0, o, 'Statement', 'let t' || turn || ' = a;' FROM f WHERE k = 0
  UNION ALL SELECT conv_id, 0, o + x.i, x.kind, x.text FROM f JOIN (VALUES (1, 0, 'Branch', left('if a > 1 {{ let u = 1; }} else {{ let w = 2; let x = 3; }}', 50)), (1, 1, 'Merge', '<merge>'), (1, 2, 'Statement', 'let u = 1;'), (1, 3, 'Statement', 'let w = 2;'), (1, 4, 'Statement', 'let x = 3;'),
    (2, 0, 'LoopHeader', 'while a > 2 {{ step(); }}'), (2, 1, 'Merge', '<merge>'), (2, 2, 'Statement', 'step();'), (3, 0, 'LoopHeader', 'loop {{ step(); }}'), (3, 1, 'Merge', '<merge>'), (3, 2, 'Statement', 'step();'),
    (4, 0, 'Branch', 'match'), (4, 1, 'Merge', '<merge>'), (4, 2, 'Statement', 'one()'), (4, 3, 'Statement', 'two()'), (5, 0, 'Statement', '{{ let n = 1; {{ let m = 2; }} }}')) x(k, i, kind, text) USING (k))""")
def cfg_nodes_of_programs(spark, sf_dir):
    """Every control-flow node with its kind and text."""
    files = _programs(spark, sf_dir)
    return _with_conv(files, rust.analyze(files.select("file_id", "content")).cfg_nodes).select("conv_id", "function_id", "node_id", "kind", "statement")


@query(f"""WITH {SIZES_SQL}, s AS (
  SELECT conv_id, 0 AS symbol_id, 'p' || conv_id AS name, 'Function' AS kind, 0 AS scope_id, 'File' AS scope FROM z
  UNION ALL SELECT conv_id, x.i, x.name, 'Parameter', 1, 'Function' FROM z, (VALUES (1, 'a'), (2, 'b')) x(i, name)
  UNION ALL SELECT conv_id, b, 't' || turn, 'Variable', 2, 'Block' FROM f WHERE k = 0
  UNION ALL SELECT conv_id, b + x.i, x.name, 'Variable', c + x.j, 'Block' FROM f JOIN (VALUES (1, 0, 'u', 0), (1, 1, 'w', 1), (1, 2, 'x', 1), (5, 0, 'n', 0), (5, 1, 'm', 1)) x(k, i, name, j) USING (k)
  UNION ALL SELECT conv_id, sy, 'q' || conv_id, 'Function', 0, 'File' FROM z UNION ALL SELECT conv_id, sy + 1, 'c', 'Parameter', sc, 'Function' FROM z UNION ALL SELECT conv_id, sy + 2, 'z', 'Variable', sc + 1, 'Block' FROM z)
SELECT conv_id, CAST(symbol_id AS BIGINT) AS symbol_id, name, kind, CAST(scope_id AS BIGINT) AS scope_id, scope FROM s""")
def symbols_of_programs(spark, sf_dir):
    """Every symbol - functions, parameters, variables - with its scope, nested blocks among them."""
    files = _programs(spark, sf_dir)
    facts = rust.analyze(files.select("file_id", "content"))
    scopes = facts.scopes.select("file_id", "scope_id", F.col("kind").alias("scope"))
    return _with_conv(files, facts.symbols.join(scopes, ["file_id", "scope_id"])).select("conv_id", "symbol_id", "name", "kind", "scope_id", "scope")


@query(f"""WITH {CFG_SQL}, v AS (SELECT conv_id, string_agg({BE.format('turn')} || lower(hex(encode('Variable {{ name: "t' || turn || '" }}'))), '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id),
d AS (SELECT conv_id, string_agg({BE.format('turn - 1')} || {BE.format('turn')} || lower(hex(encode('Use'))), '' ORDER BY turn) AS s FROM conversations WHERE turn > 0 GROUP BY conv_id)
SELECT conv_id, sha256(unhex({BE.format('conv_id')} || v.s || coalesce(d.s, ''))) AS dfg_hash FROM v LEFT JOIN d USING (conv_id)""")
def dfg_hash(spark, sf_dir):
    """A value a turn, used by the next one."""
    t = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    none = F.lit(None).cast("string")
    value = F.struct(F.lit("Variable").alias("tag"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"), none.alias("value"), F.lit(None).cast("int").alias("position"))
    edges = t.filter("turn > 0").select("conv_id", F.col("turn").alias("seq"), (F.col("turn") - 1).alias("src"), F.col("turn").alias("dst"), F.lit("Use").alias("kind"))
    return H.dfg_hashes(t.select("conv_id", F.col("turn").alias("value_id"), value.alias("value")), edges, "conv_id")


@query(f"""WITH {CFG_SQL}, o AS (SELECT conv_id, CAST(coalesce(sum(turns + 2) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM z),
gn AS (SELECT base + node_id AS id, rs, re FROM n JOIN o USING (conv_id)), ge AS (SELECT row_number() OVER (ORDER BY conv_id, seq) - 1 AS id, base + src AS src, base + dst AS dst FROM e JOIN o USING (conv_id))
SELECT (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM ge) AS edges, sha256(unhex((SELECT {_le('count(*)')} || string_agg({_le('id')} || '01' || {_le('rs')} || {_le('re')}, '' ORDER BY id) FROM gn) || (SELECT {_le('count(*)')} || string_agg({_le('id')} || '02' || {_le('src')} || {_le('dst')}, '' ORDER BY id) FROM ge))) AS cpg_hash""")
def whole_graph_hash(spark, sf_dir):
    """The streamed fingerprint of one graph of all conversations."""
    nodes, edges = _conversation_cfg(spark, sf_dir)
    numbered = dense_ids(nodes, ["conv_id"], ["node_id"], "id").withColumn("kind", F.lit("CfgNode"))
    base = numbered.filter("node_id = 0").select("conv_id", F.col("id").alias("base"))
    flow = dense_ids(edges.join(base, "conv_id"), ["conv_id"], ["seq"], "id")
    flow = flow.select("id", F.lit("ControlFlow").alias("kind"), (F.col("base") + F.col("src")).alias("src"), (F.col("base") + F.col("dst")).alias("dst"))
    return spark.createDataFrame([(numbered.count(), flow.count(), H.graph_hash(numbered, flow))], "nodes long, edges long, cpg_hash string")


@query(f"""WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS h FROM documents)
SELECT sha256(unhex(string_agg(substr(sha256(path), 1, 16) || lower(hex(encode(path))) || {BE.format('size')} || lower(hex(encode(h))), '' ORDER BY substr(sha256(path), 1, 16)))) AS snapshot_hash FROM f""")
def whole_snapshot_hash(spark, sf_dir):
    """The streamed snapshot hash of one repository that has all documents."""
    text = F.coalesce("text", F.lit(""))
    f = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length(text).alias("size"), H.content_hash(text).alias("content_hash"))
    return spark.createDataFrame([(snapshot_hash(f),)], "snapshot_hash string")


# --- semantic epoch ----------------------------------------------------------------------------------

IFS_SQL = "t AS (SELECT conv_id, turn, turn % 2 AS odd, CAST(2 + coalesce(sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 3 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o, sum(turn % 2) OVER (PARTITION BY conv_id ORDER BY turn) AS j, sum(turn % 2) OVER (PARTITION BY conv_id) AS ifs FROM conversations)"


@query(f"WITH {IFS_SQL} SELECT conv_id, o + 2 AS node_id, CAST(ifs - greatest(j, 2) + 1 AS BIGINT) AS edges FROM t WHERE odd = 1 AND ifs >= 2")
def tracked_dfg(spark, sf_dir):
    """Nodes whose statement's value has data-flow edges: definitions that meet at the branches' merges."""
    files = _sources(spark, sf_dir)
    tracked = SemanticEpoch.build(rust.analyze(files.select("file_id", "content")), 1).cfg_to_dfg()
    return _with_conv(files, tracked).groupBy("conv_id", "node_id").agg(F.count("*").alias("edges"))


@query("""WITH c AS (SELECT min(conv_id) AS conv_id FROM conversations), x AS (SELECT 'let t0 = ' || length(coalesce(text, '')) || ';' AS s FROM conversations JOIN c USING (conv_id) WHERE turn = 0)
SELECT 'node' AS what, CAST(2 AS BIGINT) AS id, 'Statement' AS kind, s AS text FROM x UNION ALL SELECT 'value', 0, 'Variable', 't0' FROM x""")
def semantic_lookup(spark, sf_dir):
    """A control-flow node and a data-flow value by their ids, and ids that are not there."""
    files = _sources(spark, sf_dir)
    epoch = SemanticEpoch.build(rust.analyze(files.select("file_id", "content")), 1)
    fid = files.orderBy("conv_id").first()["file_id"]
    node = lambda i: epoch.get_node(fid, 0, i).select(F.lit("node").alias("what"), F.col("node_id").alias("id"), "kind", F.col("statement").alias("text"))
    value = lambda i: epoch.get_value(fid, 0, i).select(F.lit("value").alias("what"), F.col("value_id").alias("id"), F.col("value.tag").alias("kind"), F.col("value.name").alias("text"))
    return node(2).union(node(10**9)).union(value(0)).union(value(10**9))


@query("SELECT substr(sha256('src/c' || conv_id || '.rs'), 1, 16) AS file_id FROM conversations GROUP BY conv_id")
def semantic_file_ids(spark, sf_dir):
    """Files of the semantic epoch."""
    return SemanticEpoch.build(rust.analyze(_sources(spark, sf_dir).select("file_id", "content")), 1).file_ids()


@query(f"WITH {CFG_SQL} SELECT (SELECT count(*) FROM (SELECT DISTINCT rs, re FROM t)) AS ast_mappings, (SELECT count(DISTINCT turn) FROM t) AS cfg_mappings")
def invalidation_stats(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("node_id", F.col("turn").cast("long"))
    return changes.invalidation_stats(t, t.select("node_id", F.col("node_id").alias("edge_id")))


# --- a repository on disk ---------------------------------------------------------------------------

REPO_SQL = """repo AS (SELECT 'src/r' || n_regionkey || '/n' || n_nationkey || '.rs' AS path, 'fn n' || n_nationkey || '() { let r = ' || n_regionkey || '; }' || chr(10) AS content, n_nationkey, n_regionkey FROM nation
UNION ALL SELECT 'docs/r' || r_regionkey || '.txt', r_name, NULL, NULL FROM region),
files AS (SELECT *, substr(sha256(path), 1, 16) AS file_id, octet_length(encode(content)) AS size, sha256(content) AS content_hash FROM repo)"""


@contextmanager
def _repository(spark, sf_dir):
    """Its folder: a program per nation, a note per region. Both tables are fixed in size (25 and 5 rows)."""
    store = Store(spark, f"{shared_dir(spark)}/repo-{uuid.uuid4().hex}")
    for r in read(spark, sf_dir, "nation").collect():
        store.write(f"src/r{r['n_regionkey']}/n{r['n_nationkey']}.rs", f"fn n{r['n_nationkey']}() {{ let r = {r['n_regionkey']}; }}\n")
    for r in read(spark, sf_dir, "region").collect():
        store.write(f"docs/r{r['r_regionkey']}.txt", r["r_name"])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        with settings(spark, spark__sql__files__maxPartitionBytes=size):  # an engine sets its own
            yield store
    finally:
        store.remove("")


@query(f"WITH {REPO_SQL} SELECT path, file_id, size, content_hash, CASE WHEN path LIKE '%.rs' THEN 'Rust' END AS language, path LIKE '%.rs' AS kept FROM files")
def repo_scan(spark, sf_dir):
    """Records of all files, and whether a scan for one extension has them."""
    with _repository(spark, sf_dir) as repo:
        scanner = RepoScanner(spark, repo.root)
        kept = scanner.with_extensions("rs").scan().select("file_id", F.lit(True).alias("kept"))
        rows = scanner.scan().join(kept, "file_id", "left").select("path", "file_id", F.col("size").cast("long").alias("size"), "content_hash", "language", F.coalesce("kept", F.lit(False)).alias("kept"))
        return spark.createDataFrame(rows.collect(), rows.schema)  # 30 rows


INGEST_SQL = f"""{REPO_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY file_id) - 1 AS rank, length(content) - 1 AS fe, position('let' IN content) - 1 AS ss, position(';' IN content) AS se FROM files WHERE n_nationkey IS NOT NULL),
gn AS (SELECT 7 * rank + i AS id, k, CASE WHEN k IN (5, 4) THEN 0 WHEN i IN (4, 5) THEN ss ELSE 0 END AS rs, CASE WHEN k IN (5, 4) THEN 0 WHEN i IN (4, 5) THEN se ELSE fe END AS re FROM r, (VALUES (0, 5), (1, 4), (2, 1), (3, 1), (4, 1), (5, 2), (6, 3)) x(i, k)),
ge AS (SELECT 2 * rank + i AS id, 7 * rank + a AS src, 7 * rank + b AS dst FROM r, (VALUES (0, 2, 4), (1, 4, 3)) x(i, a, b)),
h AS (SELECT sha256(unhex((SELECT {_le('count(*)')} || string_agg({_le('id')} || lpad(lower(hex(k)), 2, '0') || {_le('rs')} || {_le('re')}, '' ORDER BY id) FROM gn) || (SELECT {_le('count(*)')} || string_agg({_le('id')} || '02' || {_le('src')} || {_le('dst')}, '' ORDER BY id) FROM ge))) AS cpg_hash,
  (SELECT sha256(unhex(string_agg(file_id || lower(hex(encode(path))) || {BE.format('size')} || lower(hex(encode(content_hash))), '' ORDER BY file_id))) FROM r) AS snapshot_hash, (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM ge) AS edges)"""


@query(f"WITH {INGEST_SQL} SELECT CAST(1 AS BIGINT) AS epoch_id, nodes, edges, cpg_hash, snapshot_hash FROM h")
def ingest(spark, sf_dir):
    """A folder scanned, parsed, fused and fingerprinted by the engine."""
    with _repository(spark, sf_dir) as repo:
        e = Engine(spark).load_repo(repo.root)
        return spark.createDataFrame([(e.epoch_id, e.graph.nodes.count(), e.graph.edges.count(), e.cpg_hash, e.snapshot_hash)], "epoch_id long, nodes long, edges long, cpg_hash string, snapshot_hash string")


@query(f"WITH {INGEST_SQL} SELECT 'success' AS status, CAST(1 AS BIGINT) AS epoch_id, cpg_hash, nodes FROM h")
def cli_ingest(spark, sf_dir):
    """The command line's answer to ``ingest``."""
    with _repository(spark, sf_dir) as repo:
        got = cli.run(cli.parser().parse_args(["ingest", repo.root]), spark)
        return spark.createDataFrame([(got["status"], got["epoch_id"], got["cpg_hash"], got["nodes"])], "status string, epoch_id long, cpg_hash string, nodes long")


@query(f"""WITH {INGEST_SQL} SELECT x.step, CASE x.step WHEN 'nodes loaded' THEN nodes WHEN 'edges loaded' THEN edges ELSE x.n END AS n, CASE WHEN x.step IN ('saved', 'verified') THEN cpg_hash END AS cpg_hash
FROM h, (VALUES ('saved', CAST(1 AS BIGINT)), ('saved again', 2), ('verified', 1), ('nodes loaded', 0), ('edges loaded', 0), ('functions found', 25), ('changed manifest refused', 1)) x(step, n)""")
def snapshot_roundtrip(spark, sf_dir):
    """Saved twice, verified, loaded, queried; a manifest with another fingerprint is refused."""
    with _repository(spark, sf_dir) as repo:
        engine, out = Engine(spark), []
        epoch, root = engine.load_repo(repo.root), f"{repo.root}/snapshots"
        n, digest = engine.snapshot_save(epoch, root)
        out += [("saved", n, digest), ("saved again", engine.snapshot_save(epoch, root)[0], None), ("verified", 1, engine.snapshot_verify(f"{root}/snap-1").cpg_hash)]
        loaded = engine.snapshot_load(f"{root}/snap-1")
        found = engine.fetch_result(engine.run_query(loaded, {"op": "find_nodes", "kind": "Function"})).count()
        out += [("nodes loaded", loaded.graph.nodes.count(), None), ("edges loaded", loaded.graph.edges.count(), None), ("functions found", found, None)]
        second = Store(spark, f"{root}/snap-2")
        second.write("manifest.json", second.read("manifest.json").replace(digest[:8], digest[:8][::-1]))
        try:
            verify(spark, f"{root}/snap-2")
        except SnapshotError:
            out.append(("changed manifest refused", 1, None))
        return spark.createDataFrame(out, "step string, n long, cpg_hash string")


@query("""SELECT * FROM (VALUES ('empty', 'Clean', NULL), ('saved', 'Clean', NULL), ('operation started', 'PartialEpoch', NULL), ('recovered', 'Clean', CAST(1 AS BIGINT)), ('operation completed', 'Clean', NULL), ('write left over', 'PartialEpoch', NULL),
('recovered again', 'Clean', 1), ('second snapshot changed', 'Clean', 1), ('manifest gone', 'Corrupted', NULL)) x(step, state, last_valid)""")
def recovery_states(spark, sf_dir):
    """States of a snapshot folder from empty to corrupted, and what recovery falls back to."""
    with _repository(spark, sf_dir) as repo:
        root, out = f"{repo.root}/snapshots", []
        manager, store = RecoveryManager(spark, root), Store(spark, root)
        note = lambda step, last=None: out.append((step, manager.state(), last))
        note("empty")
        engine = Engine(spark)
        epoch = engine.load_repo(repo.root)
        engine.snapshot_save(epoch, root)
        note("saved")
        manager.mark_start("ingest")
        note("operation started")
        last = manager.recover()
        note("recovered", last)
        manager.mark_start("ingest"), manager.mark_complete("ingest")
        note("operation completed")
        store.write("_tmp-x/nodes", "")
        note("write left over")
        last = manager.recover()
        note("recovered again", last)
        engine.snapshot_save(epoch, root)
        two = Store(spark, f"{root}/snap-2")
        two.write("manifest.json", two.read("manifest.json").replace(epoch.cpg_hash, "0" * 64))
        note("second snapshot changed", manager.last_valid())
        two.remove("manifest.json")
        note("manifest gone")
        return spark.createDataFrame(out, "step string, state string, last_valid long")


# --- queries, plans, indices, metrics ----------------------------------------------------------------

JSON_QUERIES = {
    "find": {"op": "find_nodes", "kind": "nation"},
    "follow": {"op": "follow_edge", "from": 2 * BASE + 7, "kind": "contains"},
    "filter": {"op": "filter", "ids": [2 * BASE + 1, 77, 3 * BASE + 1, 2 * BASE + 1], "kind": "nation"},
    "intersect": {"op": "intersect", "a": {"op": "find_nodes", "kind": "nation"}, "b": {"op": "follow_edge", "from": BASE + 2, "kind": "contains"}},
    "reachable": {"op": "reachable_within", "from": BASE + 1, "depth": 2},
    "steps": {"steps": [{"op": "find_nodes", "kind": "region"}, {"op": "follow_edge", "kind": "contains"}, {"op": "filter", "kind": "nation"}]},
}


@query("""WITH @GRAPH SELECT 'find' AS query, id FROM nodes WHERE kind = 'nation' UNION ALL SELECT 'follow', dst FROM links WHERE src = 20000000007 AND kind = 'contains'
UNION ALL SELECT 'filter', 20000000001 FROM (VALUES (1), (2)) UNION ALL SELECT 'intersect', dst FROM links WHERE src = 10000000002 AND kind = 'contains'
UNION ALL SELECT 'reachable', id FROM (SELECT 10000000001 AS id UNION SELECT dst FROM links WHERE src = 10000000001 UNION SELECT b.dst FROM links a JOIN links b ON b.src = a.dst WHERE a.src = 10000000001)
UNION ALL SELECT 'steps', dst FROM links WHERE kind = 'contains' AND src < 20000000000""")
def json_queries(spark, sf_dir):
    """The JSON query language, each operator and a chain of steps."""
    g = PropertyGraph(fk_nodes(spark, sf_dir), fk_links(spark, sf_dir).withColumn("id", F.lit(0).cast("long")))
    out = None
    for name, q in JSON_QUERIES.items():
        rows = compile_query(g, q).select(F.lit(name).alias("query"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT * FROM (VALUES (1, 'first', FALSE, CAST(0 AS BIGINT)), (2, 'again', TRUE, 1), (3, 'fields in another order', TRUE, 1), (4, 'another graph', FALSE, 1), (5, 'cleared', FALSE, 0)) x(step, what, hit, held)")
def plan_cache(spark, sf_dir):
    """Plans are found by query and graph, whatever the order of a query's fields."""
    g, cache, out = PropertyGraph(fk_nodes(spark, sf_dir), fk_links(spark, sf_dir)), PlanCache(), []
    note = lambda what, q, graph: out.append((len(out) + 1, what, cache.get(q, graph) is not None, len(cache)))
    q = {"op": "find_nodes", "kind": "nation"}
    note("first", q, "g1")
    cache.put(q, "g1", compile_query(g, q))
    note("again", q, "g1")
    note("fields in another order", dict(reversed(q.items())), "g1")
    note("another graph", q, "g2")
    cache.clear()
    note("cleared", q, "g1")
    return spark.createDataFrame(out, "step int, what string, hit boolean, held long")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), TRUE, TRUE, TRUE), (2, FALSE, TRUE, TRUE), (3, FALSE, FALSE, TRUE)) x(task_id, at_start, after_1, after_2)")
def task_readiness(spark, sf_dir):
    """Tasks are ready once all that they depend on is done."""
    tasks = [Task(1, FindNodes("nation"), 0), Task(2, FindNodes("part"), 1, (1,)), Task(3, FindNodes("order"), 2, (1, 2))]
    return spark.createDataFrame([(t.task_id, t.is_ready(set()), t.is_ready({1}), t.is_ready({1, 2})) for t in tasks], "task_id long, at_start boolean, after_1 boolean, after_2 boolean")


@query("WITH @GRAPH SELECT id FROM edges WHERE src = 20000000007 AND kind = 'contains'")
def index_probe(spark, sf_dir):
    """Edge ids of one node and kind, from the built index."""
    i = indices.Indices.build(_as_values(fk_nodes(spark, sf_dir), "Symbol", "Symbol"), fk_edges(spark, sf_dir))
    return i.edges_of(2 * BASE + 7, "contains")


@query("""WITH @GRAPH, x AS (SELECT src, dst FROM links WHERE kind = 'supplies' AND src = 40000000001), n AS (SELECT count(*) + 1 AS n FROM x), m AS (SELECT dst, count(*) + 1 AS n FROM (SELECT src AS dst FROM links WHERE kind = 'supplies' UNION ALL SELECT src FROM links WHERE kind = 'contains' AND dst BETWEEN 30000000000 AND 39999999999) GROUP BY dst)
SELECT target, (SELECT max(n) FROM m) <= 100 AS complete FROM (SELECT 40000000001 AS target UNION ALL SELECT dst FROM x) WHERE (SELECT n FROM n) <= 100""")
def points_to_of(spark, sf_dir):
    """The set of one value, and whether the analysis is complete."""
    found = _overflow(spark, sf_dir)
    return found.of(4 * BASE + 1).withColumn("complete", F.lit(found.complete))


@query("""WITH v AS (SELECT n_nationkey, CAST(100 * (n_nationkey + 1) AS BIGINT) AS v FROM nation), l AS (SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, list(v ORDER BY v) AS s FROM v)
SELECT n, total, CAST(total // n AS BIGINT) AS mean, s[CAST(n // 2 AS BIGINT) + 1] AS p50, s[CAST(n * 95 // 100 AS BIGINT) + 1] AS p95, s[CAST(n * 99 // 100 AS BIGINT) + 1] AS p99, CAST(30 AS BIGINT) AS memory, CAST(7 AS BIGINT) AS reparsed, CAST(500 AS BIGINT) AS scan_micros FROM l""")
def metrics_collector(spark, sf_dir):
    """A run's own record: the last write of a file counts."""
    m = MetricsCollector()
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows
        m.record_parse(str(r["n_nationkey"]), 1)
        m.record_parse(str(r["n_nationkey"]), 100 * (r["n_nationkey"] + 1))
    m.record_scan(500), m.record_epoch_memory(1, 10), m.record_epoch_memory(2, 20), m.record_reparsed(7)
    s = m.parse_stats()
    row = tuple(s[k] for k in ("n", "total", "mean", "p50", "p95", "p99")) + (m.total_memory(), m.reparsed, m.scan_micros)
    return spark.createDataFrame([row], "n long, total long, mean long, p50 long, p95 long, p99 long, memory long, reparsed long, scan_micros long")


@query("""WITH @GRAPH SELECT 'region' AS kind, id FROM nodes WHERE kind = 'region' UNION ALL SELECT 'edges_to', src FROM links WHERE dst = 30000000001""")
def nodes_of_kind(spark, sf_dir):
    """Accessors: nodes of a kind, and what leads to a node."""
    to = P.edges_to(fk_links(spark, sf_dir), 3 * BASE + 1).select(F.lit("edges_to").alias("kind"), F.col("src").alias("id"))
    return P.nodes_of_kind(fk_nodes(spark, sf_dir), "region").select("kind", "id").union(to)
