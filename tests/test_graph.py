"""Primitives, indices and fingerprints on hand-built graphs with absolute expected values."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import hashing as H
from weftgraph.functions.metrics import MetricsCollector, large_time_stats, latest, time_stats
from weftgraph.functions.ordering import dense_ids
from weftgraph.model import InvariantError, PropertyGraph
from weftgraph.operators import primitives as P
from weftgraph.operators.hops import Hops
from weftgraph.operators.indices import Indices

NODE, EDGE = "id long, kind string, range_start long, range_end long", "id long, kind string, src long, dst long"

GRAPHS = {
    "empty": ([], [], "374708fff7719dd5979ec875d56cd2286f6d3cf7ec317a3b25632aab28ec37bb"),
    "one": ([(1, "Function", 0, 10)], [], "14d31b7b95fb6dc33e2a5866961414a2532d40d669d6b9b839c80a904d9c198f"),
    "flow": ([(1, "Function", 0, 10), (2, "CfgNode", 0, 10)], [(1, "ControlFlow", 1, 2)], "357b8669c8ce0ead4ddb1d4537482a5c2b29e9a04f43d52724c1ba3689a56f59"),
    "data": ([(1, "DfgValue", 0, 10), (2, "DfgValue", 10, 20)], [(1, "DataFlow", 1, 2)], "e206d2ecfb0fef895d61b40d55a42534a4505d123c7ccd7bf2184d5020d700fe"),
    "hundred": ([(i, "Function", 10 * i, 10 * i + 10) for i in range(100)], [], "ed08a796b154a1f0f81f97c549b97a31eb7df41cad2d0f911e4ecfb5dcdd6058"),
}


def graph(spark, nodes, edges):
    return PropertyGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def ids(df, *order):
    return [r["id"] for r in df.orderBy(*(order or ["id"])).collect()]


@pytest.mark.parametrize("name", GRAPHS)
def test_graph_hash(spark, name):
    nodes, edges, want = GRAPHS[name]
    shuffled = list(nodes)
    random.Random(3).shuffle(shuffled)
    g = graph(spark, shuffled, edges)
    assert H.graph_hash(g.nodes, g.edges) == want
    assert H.graph_hash(g.nodes.repartition(7), g.edges) == want


def test_cfg_hash(spark):
    n = spark.createDataFrame([(1, 0, "Entry")], "function_id long, node_id long, kind string")
    e = spark.createDataFrame([(1, 0, 0, 1, "Normal")], "function_id long, seq long, src long, dst long, kind string")
    assert H.cfg_hashes(n, e, "function_id").first()["cfg_hash"] == "1c072904ffcb144f5b64e2d53afe6da35211a7f17199f2090b9c9d78477b462a"


def test_dfg_hash(spark):
    v = spark.createDataFrame([(1, 0, ("Variable", "x", None, None))], "function_id long, value_id long, value struct<tag:string,name:string,value:string,position:int>")
    e = spark.createDataFrame([], "function_id long, seq long, src long, dst long, kind string")
    assert H.dfg_hashes(v, e, "function_id").first()["dfg_hash"] == "8662356714608bff8e4218675f739b2f220baab4a404f768437670fdfff80502"


def test_byte_orders(spark):
    r = spark.range(1).select(H.be64(F.lit(258)).alias("b"), H.le64(F.lit(258)).alias("l"), H.u8(F.lit(7)).alias("u")).first()
    assert tuple(r) == ("0000000000000102", "0201000000000000", "07")


def test_primitives(spark):
    g = graph(spark, [(1, "File", 0, 0), (2, "Function", 0, 9), (3, "Function", 9, 20), (4, "CfgNode", 1, 2)], [(0, "Calls", 2, 3), (1, "Calls", 2, 3), (2, "ControlFlow", 3, 4), (3, "Calls", 4, 2)])
    assert ids(P.find_nodes(g.nodes, "Function")) == [2, 3]
    assert ids(P.find_nodes(g.nodes, "Symbol")) == []
    assert ids(P.follow_edge(g.edges, 2, "Calls"), "edge_id") == [3, 3]  # repeats stay
    starts = spark.createDataFrame([(0, 4), (1, 2), (2, 4), (3, 99)], "seq long, id long")
    assert ids(P.follow_edges(starts, g.edges, "Calls"), "seq", "edge_id") == [2, 3, 3, 2]
    some = spark.createDataFrame([(2,), (99,), (2,), (4,)], "id long")
    assert sorted(ids(P.filter_ids(some, g.nodes, "Function"))) == [2, 2]
    assert sorted(ids(P.filter_ids(some, g.nodes, None))) == [2, 2, 4, 99]
    assert sorted(ids(P.intersect(some, spark.createDataFrame([(2,), (4,), (4,)], "id long")))) == [2, 2, 4]
    assert {r["kind"]: r["nodes"] for r in P.graph_stats(g.nodes).collect()} == {"AstNode": 0, "CfgNode": 1, "DfgValue": 0, "Symbol": 0, "Function": 2, "File": 1}
    assert {tuple(r) for r in P.degrees(g.nodes, g.edges).collect()} == {(1, 0, 0), (2, 2, 1), (3, 1, 2), (4, 1, 1)}
    assert P.get_node(g.nodes, 3).first()["kind"] == "Function" and P.get_node(g.nodes, 9).first() is None
    assert ids(P.edges_from(g.edges, 2)) == [0, 1] and ids(P.edges_to(g.edges, 2)) == [3]
    assert tuple(P.epoch_stats(g.nodes, g.edges, 5).first()) == (5, 4, 4)
    i = Indices.build(g.nodes.withColumn("origin", F.lit(None).cast("struct<tag:string,file_id:string,function_id:bigint,local_id:bigint>")), g.edges)
    assert ids(i.edges_of(2, "Calls")) == [0, 1]
    assert [tuple(r) for r in i.func_calls.orderBy("id").collect()] == [(2, [4]), (3, [2, 2])]


def reach(edges, start, limit):
    depth, queue = {start: 0}, [start]
    for x in queue:
        if depth[x] < limit:
            for s, d in edges:
                if s == x and d not in depth:
                    depth[d] = depth[x] + 1
                    queue.append(d)
    return depth


@pytest.mark.parametrize("seed", range(3))
def test_reachable_within_random(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    e = spark.createDataFrame([(i, "Calls", s, d) for i, (s, d) in enumerate(pairs)], EDGE)
    found = {r["id"]: r["depth"] for r in P.reachable_within(e, spark.createDataFrame([(0,)], "id long"), 3).collect()}
    assert found == reach(pairs, 0, 3)


def test_reachable_absent_start_and_keys(spark):
    e = spark.createDataFrame([(0, "Calls", 1, 2)], EDGE)
    assert [tuple(r) for r in P.reachable_within(e, spark.createDataFrame([(50,)], "id long"), 5).collect()] == [(50, 0)]
    many = spark.createDataFrame([("a", 1), ("b", 2)], "k string, id long")
    assert {tuple(r) for r in P.reachable_within(e, many, 5, ("k",)).collect()} == {("a", 1, 0), ("a", 2, 1), ("b", 2, 0)}
    assert P.reachable_within(e.limit(0), many, 5, ("k",)).count() == 2


def test_checked(spark):
    with pytest.raises(InvariantError):
        graph(spark, [(1, "File", 5, 3)], []).checked()
    with pytest.raises(InvariantError):
        graph(spark, [(1, "Folder", 0, 0)], []).checked()
    with pytest.raises(InvariantError):
        graph(spark, [(1, "File", 0, 0)], [(0, "Calls", 1, 2)]).checked()
    graph(spark, [(1, "File", 0, 0)], [(0, "Calls", 1, 2)]).checked(linked=False)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_dense_ids(spark, partitions):
    rows = [(f"k{i % 5}", i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, b long, v long").repartition(partitions)
    got = {r["v"]: r["n"] for r in dense_ids(df, ["k", "b"], ["v"], "n").collect()}
    assert got == {v: i for i, (_, _, v) in enumerate(sorted(rows))}
    per = {(r["k"], r["v"]): r["n"] for r in dense_ids(df, ["b"], ["v"], "n", within=["k"]).collect()}
    assert sorted(n for (k, _), n in per.items() if k == "k1") == list(range(40))


def test_metrics(spark):
    df = spark.createDataFrame([("a", 300), ("a", 100), ("a", 200), ("b", None)], "k string, v long")
    want = [("a", 3, 600, 200, 200, 300, 300)]
    assert [tuple(r) for r in time_stats(df, "v", "k").collect()] == want
    assert [tuple(r) for r in large_time_stats(df, "v", "k").collect()] == want
    assert tuple(time_stats(df.limit(0), "v").first()) == (0, 0, 0, 0, 0, 0)
    writes = spark.createDataFrame([("f", 1, 10), ("f", 2, 7)], "f string, at long, v long")
    assert [tuple(r) for r in latest(writes, F.col("f"), F.col("at"), F.col("v")).collect()] == [("f", 7)]
    m = MetricsCollector()
    assert m.parse_stats()["p99"] == 0
    for f, t in (("x", 100), ("y", 200), ("z", 300)):
        m.record_parse(f, t)
    m.record_epoch_memory(1, 5), m.record_epoch_memory(1, 6), m.record_scan(9), m.record_reparsed(2)
    assert m.parse_stats() == {"n": 3, "total": 600, "mean": 200, "p50": 200, "p95": 300, "p99": 300} and m.total_memory() == 6
    assert "files parsed: 3" in m.summary() and m.to_df(spark).count() == 3


def test_sha_agrees_with_hashlib(spark):
    assert spark.range(1).select(H.file_id(F.lit("src/main.rs"))).first()[0] == hashlib.sha256(b"src/main.rs").hexdigest()[:16] == "42cb6807ad74b3e2"


def test_hubs(spark):
    """A node with most of the edges is kept apart; both parts together answer as the plain join does."""
    pairs = [(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 10)] + [(41, 42)]
    want = lambda *ids: sorted(d for s, d in pairs if s in ids)
    level = spark.createDataFrame([(0,), (3,)], "id long")
    h = Hops(spark.createDataFrame(pairs, "src long, dst long"), least=10, small=1)
    assert sorted(r["dst"] for r in h.step(level, "id", 1).collect()) == want(0, 3) and h.light is None  # a small frontier is broadcast
    assert "BroadcastHashJoin" in h.step(level, "id", 1)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["dst"] for r in h.step(level, "id", 2).collect()) == want(0, 3)
    assert h.heavy is not None and {r["src"] for r in h.heavy.collect()} == {0} and h.light.count() == 10
    even = Hops(spark.createDataFrame(pairs, "src long, dst long"), small=1)
    assert sorted(r["dst"] for r in even.step(level, "id", 2).collect()) == want(0, 3) and even.heavy is None
    plan = h.light.join(level, h.light["src"] == level["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
    h.drop()
