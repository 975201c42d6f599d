"""Source code: parser, control flow, symbols, fusion, scan, snapshots, engine, CLI, stream."""

import hashlib
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from weftgraph.cli import main
from weftgraph.config import Config, ConfigError
from weftgraph.engine import Engine
from weftgraph.functions.hashing import cfg_hashes, graph_hash
from weftgraph.model import SCHEMAS
from weftgraph.operators import points_to
from weftgraph.operators.fusion import build_dfg, call_edges, extension_edges, fuse
from weftgraph.operators.semantic import SemanticEpoch
from weftgraph.sources import rust, snapshot
from weftgraph.sources.recovery import CLEAN, CORRUPTED, PARTIAL, RecoveryManager
from weftgraph.sources.scan import EMPTY, RepoScanner, snapshot_hash
from weftgraph.streaming.repo_stream import RECORD, RepoStream


def cfg(src, **options):
    f = rust.facts_of(src.encode(), **options)
    return [(n["node_id"], n["kind"], n["range_start"], n["range_end"]) for n in f["cfg_nodes"]], [(e["src"], e["dst"], e["kind"]) for e in f["cfg_edges"]]


def cfg_hash(src):
    nodes, edges = cfg(src)
    h = hashlib.sha256(struct.pack(">Q", 0))
    for i, k, _, _ in nodes:
        h.update(struct.pack(">Q", i) + k.encode())
    for s, d, k in edges:
        h.update(struct.pack(">QQ", s, d) + k.encode())
    return h.hexdigest()


ONE = "f1698d38dcbd31364f3268c5c35b61f61207ce9f2213622edb7df12e81b28d23"


def test_one_statement():
    nodes, edges = cfg("fn test() { let x = 1; }")
    assert nodes == [(0, "Entry", 0, 24), (1, "Exit", 0, 24), (2, "Statement", 12, 22)]
    assert edges == [(0, 2, "Normal"), (2, 1, "Normal")]
    assert cfg_hash("fn test() { let x = 1; }") == ONE


def test_white_space_does_not_count():
    assert cfg_hash("fn test(){let x=1;}") == cfg_hash("fn test() {\n    let x = 1;\n}") == ONE


def test_branch():
    src = "fn test() { let x = 1; if x > 0 { let y = 2; } }"
    nodes, edges = cfg(src)
    assert [k for _, k, _, _ in nodes] == ["Entry", "Exit", "Statement", "Branch", "Merge", "Statement"]
    assert edges == [(0, 2, "Normal"), (2, 3, "Normal"), (3, 5, "Normal"), (5, 4, "Normal"), (3, 4, "False"), (4, 1, "Normal")]
    assert cfg_hash(src) == "27f675928238119be66d7621bf0de3f70bbaf36d348245e2cf2f50b0355100a2"


def test_else_and_loops():
    kinds = lambda src, **o: [k for _, k, _, _ in cfg(src, **o)[0]]
    src = "fn t() { if true { let x = 1; } else { let y = 2; let z = 3; } }"
    assert kinds(src).count("Statement") == 3 and kinds(src, opaque_else=True).count("Statement") == 2
    assert kinds("fn t() { if a { f(); } else if b { g(); } }").count("Branch") == 2
    nodes, edges = cfg("fn t() { loop { break; } }")
    merge = next(i for i, k, _, _ in nodes if k == "Merge")
    assert "LoopHeader" in [k for _, k, _, _ in nodes] and all(d != merge for _, d, _ in edges)
    _, edges = cfg("fn t() { while x { f(); } g(); }")
    assert {k for _, _, k in edges} == {"Normal", "Continue", "Break"}
    nodes, edges = cfg("fn t() { match x { 1 => a(), 2 => { b(); c() } _ => if q { d() } } }")
    assert sum(d == next(i for i, k, _, _ in nodes if k == "Merge") for _, d, _ in edges) == 3
    assert kinds("fn t() { for i in 0..3 { f(i); } }") == ["Entry", "Exit", "Statement"]


def test_precise_flow():
    edges = lambda src: cfg(f"fn t() {{ {src} }}", precise=True)[1]
    assert edges("if a { f(); } g();") == [(0, 2, "Normal"), (2, 4, "True"), (4, 3, "Normal"), (2, 3, "False"), (3, 5, "Normal"), (5, 1, "Normal")]
    assert edges("if a {} else { f(); }") == [(0, 2, "Normal"), (2, 3, "True"), (2, 4, "False"), (4, 3, "Normal"), (3, 1, "Normal")]
    assert edges("if a { return; } g();") == [(0, 2, "Normal"), (2, 4, "True"), (4, 1, "Normal"), (2, 3, "False"), (3, 5, "Normal"), (5, 1, "Normal")]
    assert edges("loop { break; }") == [(0, 2, "Normal"), (2, 4, "Normal"), (4, 3, "Break"), (3, 1, "Normal")]
    assert edges("for i in x { continue; }") == [(0, 2, "Normal"), (2, 4, "Normal"), (4, 2, "Continue"), (2, 3, "Break"), (3, 1, "Normal")]
    assert (6, 3, "Break") in edges("'a: loop { loop { break 'a; } }")
    assert edges("return; f();")[1:] == [(2, 1, "Normal"), (3, 1, "Normal")]  # f() has no way in


def test_functions_and_ids():
    f = rust.facts_of(b"fn third() {} mod m { pub(crate) async fn first(&self, a: Vec<Vec<u8>>) -> u8 { 1 } } impl<T> X<T> { fn second(mut x: T) where T: A { fn inner() {} } }")
    assert sorted({n["function_id"] for n in f["cfg_nodes"]}) == [0, 1, 2]
    assert [n["node_id"] for n in f["cfg_nodes"]] == list(range(len(f["cfg_nodes"])))
    assert [s["name"] for s in f["symbols"]] == ["third", "first", "a", "second", "x", "inner"]


def test_symbols():
    f = rust.facts_of(b"fn test(x: i32) { let y = x + 1; let z = y * 2; }")
    kind = {s["scope_id"]: s["kind"] for s in f["scopes"]}
    assert [(s["name"], s["kind"], kind[s["scope_id"]]) for s in f["symbols"]] == [("test", "Function", "File"), ("x", "Parameter", "Function"), ("y", "Variable", "Block"), ("z", "Variable", "Block")]
    f = rust.facts_of(b"fn test() { let x = 1; { let y = 2; } let (a, b) = c; let mut m = 1; }")
    assert sum(s["kind"] == "Block" for s in f["scopes"]) == 2
    assert [s["name"] for s in f["symbols"]] == ["test", "x", "y", "m"]


TRICKY = rb"""
//! doc
#![allow(x)]
use a::{b, c};
macro_rules! m { ($x:expr) => { $x }; }
const C: &str = r#"fn not() { "#;
static S: [u8; 2] = [b'{', b'\''];
pub struct P<'a> { f: &'a str }
struct U(u8, u8);
enum E { A, B(u8) }
trait T { fn sig(&self) -> u8; fn def(&self) { self.sig(); } }
extern "C" { fn ext(x: u8); }
thread_local! { static X: u8 = 1; }
impl<'a> P<'a> {
    /* block /* nested */ comment */
    pub unsafe fn run(&'a mut self, n: usize) -> Result<(), Box<dyn Fn(u8) -> u8>> {
        let c = 'x'; let s = "a\"}b";
        let f = |a: u8| { a + 1 };
        let p = P { f: "x" };
        let Some(v) = self.get() else { return Ok(()); };
        'outer: loop { if let Some(x) = it.next() && x > 1 { continue 'outer; } else { break 'outer } }
        println!("{} {}", a, b);
        vec![1, 2].iter().map(|x| x << 2 >= 3 || !x).collect::<Vec<_>>();
        unsafe { g(); }
        match n { 0 | 1 if n > 0 => {}, P { f, .. } => h(f), _ => unreachable!() }
        Ok(())
    }
}
"""


def test_tricky_source():
    f = rust.facts_of(TRICKY)
    assert not [a for a in f["ast"] if a["kind"] == "ERROR"]
    assert [s["name"] for s in f["symbols"] if s["kind"] == "Function"] == ["def", "run"]
    a = f["ast"]
    assert all(a[n["parent_id"]]["start"] <= n["start"] <= n["end"] <= a[n["parent_id"]]["end"] for n in a if n["parent_id"] is not None)


@pytest.mark.parametrize("bad", [b"fn f() {", b"fn f() { let x = 1; ", b'let s = "', b"/* x", b"fn f() { ) }", b"}"])
def test_open_source_raises(bad):
    with pytest.raises(rust.ParseError):
        rust.facts_of(bad)


def test_empty_and_non_utf8():
    assert [n["kind"] for n in rust.facts_of(b"")["ast"]] == ["source_file"]
    f = rust.facts_of("fn f() { let é = \"ü\"; }".encode())
    assert f["symbols"][1]["name"] == "é"
    assert rust.facts_of(b'fn f() { g("\xff"); }')["cfg_nodes"][2]["statement"] == 'g("�");'


# --- tables and graphs


def facts(spark, *sources):
    return rust.analyze(spark.createDataFrame([(f"{i:016x}", bytearray(s.encode())) for i, s in enumerate(sources)], "file_id string, content binary"))


def test_fused_hashes(spark):
    f = facts(spark, "fn test() { let x = 1; }")
    dfg = build_dfg(f)
    none = (dfg[0].limit(0), dfg[1].limit(0))
    linked, raw = fuse(f, none), fuse(f, none, linked=False)
    assert linked.nodes.count() == 6 and linked.edges.count() == 2
    assert graph_hash(raw.nodes, raw.edges) == "ecc6cbbb3710916665dd46edff9da140e9068481ece22cccad88a6f6d488b1d6"
    assert graph_hash(linked.nodes, linked.edges) == "52568cc0f930c618af0fd0d47e1465791491f38b087138dc12b87aea9774613f"
    assert cfg_hashes(f.cfg_nodes, f.cfg_edges, "file_id", "function_id").first()["cfg_hash"] == ONE
    linked.checked()


def test_fusion_order_and_flow(spark):
    f = facts(spark, "fn b() { let x = 1; if x { let x = 2; } g(x); }\nfn g(y: u8) { let z = y; }", "fn a() {}")
    g = fuse(f)
    n = [tuple(r) for r in g.nodes.orderBy("id").select("id", "kind", "label").collect()]
    assert [i for i, _, _ in n] == list(range(len(n)))
    assert [k for _, k, _ in n][:2] == ["File", "Function"] and n[-1][2] == "a"
    kinds = {k: sum(x == k for _, x, _ in n) for k in ("File", "Function", "DfgValue", "Symbol")}
    assert kinds == {"File": 2, "Function": 3, "DfgValue": 4, "Symbol": 3}  # x, x, their phi, z
    values, flows = build_dfg(f)
    assert sorted(r["kind"] for r in flows.collect()) == ["PhiLike", "PhiLike"]
    calls = call_edges(f, g).collect()
    label = {i: (k, x) for i, k, x in n}
    assert len(calls) == 1 and label[calls[0]["src"]][0] == "CfgNode" and label[calls[0]["dst"]][0] == "Function"
    g.checked()
    more = extension_edges(f, g, (values, flows), points_to.analyze(g.nodes.filter("kind = 'DfgValue'").select(F.col("id").alias("value")), g.edges.filter("kind = 'DataFlow'")).facts)
    rows = more.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(g.edges.count(), g.edges.count() + len(rows)))
    assert {k: sum(r["kind"] == k for r in rows) for k in ("Defines", "Calls", "PointsTo")} == {"Defines": 3, "Calls": 1, "PointsTo": 2}
    s = SemanticEpoch(f, values, flows, 4)
    assert tuple(s.stats().first())[:4] == (4, 2, 3, 2)
    assert [r["file_id"] for r in s.file_ids().orderBy("file_id").collect()] == [f"{i:016x}" for i in range(2)]
    assert s.of_file("symbols", f"{1:016x}").count() == 1
    hit, flow = s.invalidate(spark.createDataFrame([(f"{0:016x}", 9, 12)], "file_id string, start long, end long"))
    assert {(r["function_id"], r["node_id"]) for r in hit.collect()} == {(0, 0), (0, 1), (0, 2)} and flow.count() == 1
    full = fuse(f, with_ast=True).checked()
    assert full.nodes.filter("kind = 'AstNode'").count() == f.ast.count()
    assert full.edges.filter("kind = 'AstParent'").count() == f.ast.count() - 2


REPO = {"src/main.rs": "fn main() {\n    println!(\"hi\");\n}\n", "src/core/mod.rs": "pub mod engine;\n", "src/a.txt": "x"}


@pytest.fixture
def repo(tmp_path):
    for path, text in REPO.items():
        p = tmp_path / "repo" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "repo"


def test_scan(spark, repo):
    os.symlink(repo / "src/main.rs", repo / "src/link.rs")
    files = {r["path"]: r for r in RepoScanner(spark, str(repo)).scan().collect()}
    assert set(files) == set(REPO)
    for path, text in REPO.items():
        r = files[path]
        assert r["file_id"] == hashlib.sha256(path.encode()).hexdigest()[:16] and r["size"] == len(text)
        assert r["content_hash"] == hashlib.sha256(text.encode()).hexdigest() and r["language"] == ("Rust" if path.endswith(".rs") else None)
    some = RepoScanner(spark, str(repo)).with_extensions("rs").scan()
    assert some.count() == 2
    h = hashlib.sha256()
    for r in sorted(some.collect(), key=lambda r: r["file_id"]):
        h.update(bytes.fromhex(r["file_id"]) + r["path"].encode() + struct.pack(">Q", r["size"]) + r["content_hash"].encode())
    assert snapshot_hash(some) == h.hexdigest()
    assert snapshot_hash(some.limit(0)) == EMPTY
    assert RepoScanner(spark, str(repo), follow_symlinks=True).scan().count() == 4
    assert [r["path"] for r in RepoScanner(spark, str(repo / "src/main.rs")).scan().collect()] == ["main.rs"]
    with pytest.raises(FileNotFoundError):
        RepoScanner(spark, str(repo / "nothing"))


def test_engine(spark, repo, tmp_path, capsys):
    e = Engine(spark)
    one = e.load_repo(str(repo))
    assert e.stats(one).filter("kind = 'Function'").first()["nodes"] == 1
    r = e.run_query(one, {"op": "find_nodes", "kind": "Function"})
    fn = e.fetch_result(r).first()["id"]
    q = e.run_query(one, {"op": "find_nodes", "kind": "CfgNode"})
    start = e.fetch_result(q).orderBy("id").first()["id"]
    assert e.run_query(one, {"op": "find_nodes", "kind": "CfgNode"}) == q + 1 and len(e.plans) == 2
    how = {x["node"]: (x["node_path"], x["origin"]["tag"]) for x in e.explain_result(q, start).collect()}
    assert how[start] == ([start], "Cfg") and len(how) == 3 and fn not in how
    (repo / "src/new.rs").write_text("fn extra() { let a = 1; let b = a; }")
    (repo / "src/a.rs").write_text("fn x() {}")
    two, changes = e.update_files(one, str(repo))
    assert {x["change"] for x in changes.collect()} == {"Added", "Unchanged"} and e.metrics.reparsed == 2
    again = Engine(spark).load_repo(str(repo))
    assert two.cpg_hash == again.cpg_hash != one.cpg_hash and two.snapshot_hash == again.snapshot_hash
    assert e.points_to(two).stats().first()["completed"]
    assert e.indices(two).var_uses.count() == 1
    root = str(tmp_path / "snaps")
    assert e.snapshot_save(one, root)[0] == 1 and e.snapshot_save(two, root) == (2, two.cpg_hash)
    back = e.snapshot_load(f"{root}/snap-2")
    assert back.cpg_hash == two.cpg_hash and back.graph.nodes.count() == two.graph.nodes.count()
    query = tmp_path / "q.json"
    query.write_text('{"op": "find_nodes", "kind": "Function"}')
    assert main(["query", str(query), "--snapshot", f"{root}/snap-2"], spark) == 0
    assert json.loads(capsys.readouterr().out)["count"] == 3
    assert main(["snapshot", "verify", f"{root}/snap-1"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"status": "success", "hash": one.cpg_hash, "valid": True}
    assert main(["explain", str(start), "--snapshot", f"{root}/snap-1", "--from", str(start)], spark) == 0
    assert json.loads(capsys.readouterr().out)["provenance"] == [f"node {start}"]
    m = RecoveryManager(spark, root)
    assert m.state() == CLEAN and m.recover() is None
    m.mark_start("ingest")
    assert m.state() == PARTIAL and m.recover() == 2 and m.state() == CLEAN
    # A snapshot whose tables do not fit its manifest is refused; so is another version.
    old = json.loads(snapshot.Store(spark, f"{root}/snap-2").read("manifest.json"))
    store = snapshot.Store(spark, f"{root}/snap-2")
    store.write("manifest.json", json.dumps(old | {"cpg_hash": "0" * 64}))
    with pytest.raises(snapshot.SnapshotError):
        e.snapshot_verify(f"{root}/snap-2")
    assert m.last_valid() == 1
    store.write("manifest.json", json.dumps(old | {"version": 999}))
    assert main(["snapshot", "verify", f"{root}/snap-2"], spark) == 1
    assert json.loads(capsys.readouterr().err)["fatal"] is True
    assert m.state() == CORRUPTED
    with pytest.raises(snapshot.SnapshotError):
        m.recover()


def test_cli_ingest(spark, repo, capsys):
    assert main(["ingest", str(repo)], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["status"] == "success" and out["epoch_id"] == 1 and out["nodes"] > 5
    assert main(["ingest", str(repo / "nothing")], spark) == 1


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[io]\nmode = 'cold'\n[analysis]\nmax_taint_depth = 10\n")
    c = Config.load(str(p))
    assert c.io.mode == "cold" and c.analysis.max_taint_depth == 10 and c.snapshot.auto_save
    assert Config.load(None, str(tmp_path / "none.toml")) == Config()
    for bad in ("[repo]\nx = 1", "[io]\nmode = 'warm'", "[io]\nmode = 3", "io = 1", "[io"):
        p.write_text(bad)
        with pytest.raises(ConfigError):
            Config.load(str(p))
    with pytest.raises(ConfigError):
        Config.load(str(tmp_path / "none.toml"))


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    got = []
    s = RepoStream(spark, str(tmp_path / "state"))

    def push(name, rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("file_id", "content_hash", "version", "deleted"), r))) for r in rows))
        records = spark.readStream.schema(RECORD).json(str(inbox))
        s.start(records, str(tmp_path / "ck"), lambda i, df: got.append({tuple(r) for r in df.collect()})).awaitTermination()

    push("1.json", [("a", "1", 1, False), ("b", "1", 1, False), ("a", "0", 0, False)])
    push("2.json", [("a", "2", 2, False), ("b", None, 2, True), ("c", "1", 2, False)])
    assert got == [{("a", "Added"), ("b", "Added")}, {("a", "Modified"), ("b", "Deleted"), ("c", "Added")}]
    assert {tuple(r) for r in s.current().collect()} == {("a", "2"), ("c", "1")}


def test_savers_at_once(spark, tmp_path):
    """Two savers never share a number, and one that failed with its claim only leaves a gap."""
    from concurrent.futures import ThreadPoolExecutor

    from weftgraph.model import PropertyGraph

    nodes = spark.createDataFrame([(i, "Function", 4, None, i, i + 1, None) for i in range(3)], SCHEMAS["nodes"])
    graph = PropertyGraph(nodes, spark.createDataFrame([], SCHEMAS["edges"]))
    with ThreadPoolExecutor(3) as pool:
        ids = sorted(n for n, _ in pool.map(lambda _: snapshot.save(graph, str(tmp_path)), range(3)))
    assert ids == [1, 2, 3] == snapshot.snapshot_ids(spark, str(tmp_path))
    assert snapshot.Store(spark, str(tmp_path)).claim("_claim-4") and not snapshot.Store(spark, str(tmp_path)).claim("_claim-4")
    assert snapshot.save(graph, str(tmp_path))[0] == 5
    assert all(snapshot.verify(spark, f"{tmp_path}/snap-{n}") for n in (1, 2, 3, 5))
