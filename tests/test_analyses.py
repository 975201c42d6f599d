"""Taint, points-to, data flow, changes, plans: fixtures, bounds and random models."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.model import InvariantError, PropertyGraph
from weftgraph.operators import changes, dataflow, points_to, taint
from weftgraph.plans.cost import PlanCache, QueryCost, cost
from weftgraph.plans.json_query import QueryError, compile_query
from weftgraph.plans.tasks import ExecutionPlan, Filter, FindNodes, FollowEdges, Intersect, Reachable, Stage, Task

EDGE = "id long, kind string, src long, dst long"


def edges(spark, pairs, kind="DataFlow"):
    return spark.createDataFrame([(i, kind, s, d) for i, (s, d) in enumerate(pairs)], EDGE)


def marks(spark, *nodes, kind="Parameter"):
    return spark.createDataFrame([(i, kind, n) for i, n in enumerate(nodes)], "source long, kind string, node long")


def sinks(spark, *nodes):
    return spark.createDataFrame([("FunctionCall", n) for n in nodes], "kind string, node long")


def fifo(pairs, start, ends, limit=50):
    """The expected semantics in plain Python: paths by first-in-first-out search."""
    out, seen, queue = [], {start}, [(start, [start])]
    for node, path in queue:
        if len(path) - 1 >= limit:
            continue
        out += [path for e in ends if e == node]
        for s, d in pairs:
            if s == node and d not in seen:
                seen.add(d)
                queue.append((d, [*path, d]))
    return out


def test_taint_simple(spark):
    r = taint.analyze(edges(spark, [(1, 2)]), marks(spark, 1), sinks(spark, 2))
    assert [x["node_path"] for x in r.paths.collect()] == [[1, 2]]
    assert sorted(x["node"] for x in r.tainted().collect()) == [1, 2]
    assert tuple(r.stats().first()) == (1, 2)
    nodes = spark.createDataFrame([(2,), (3,)], "node long")
    assert {tuple(x) for x in r.is_tainted(nodes).collect()} == {(2, True), (3, False)}


def test_taint_source_is_sink_and_other_kinds(spark):
    e = edges(spark, [(1, 2)], "ControlFlow")
    r = taint.analyze(e, marks(spark, 1), sinks(spark, 1, 2, 1))
    assert [x["node_path"] for x in r.paths.collect()] == [[1], [1]]


@pytest.mark.parametrize("seed", range(3))
def test_taint_random(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(22)]
    ends = [3, 5, 5]
    r = taint.analyze(edges(spark, pairs).repartition(3), marks(spark, 0, 1), sinks(spark, *ends))
    got = sorted((x["source"], x["node_path"]) for x in r.paths.collect())
    assert got == sorted((i, p) for i, s in enumerate((0, 1)) for p in fifo(pairs, s, ends))


def test_taint_depth_cap(spark):
    """Of a long chain nodes at depth 0 to 49 are tainted; a cap of 6 makes that cheap to see."""
    r = taint.analyze(edges(spark, [(i, i + 1) for i in range(12)]), marks(spark, 0), sinks(spark, 5, 6), max_depth=6)
    assert sorted(x["node"] for x in r.tainted().collect()) == list(range(6))
    assert [x["sink_id"] for x in r.paths.collect()] == [5]
    assert taint.MAX_DEPTH == 50


def values(spark, n):
    return spark.range(n).select(F.col("id").alias("value"))


def test_points_to_parity_mode(spark):
    p = points_to.analyze(spark.createDataFrame([(1,), (2,)], "value long"), edges(spark, [(1, 2)]), "none")
    assert p.complete and {tuple(r) for r in p.sets().collect()} == {(1, 0, False), (2, 0, False)}
    assert tuple(p.stats().first()) == (2, 2, 0, 0, True)


@pytest.mark.parametrize("seed", range(2))
def test_points_to_random(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(8), rng.randrange(8)) for _ in range(12)]
    sets = {i: {i} for i in range(8)}
    while any(not sets[s] <= sets[d] for s, d in pairs):
        for s, d in pairs:
            sets[d] |= sets[s]
    p = points_to.analyze(values(spark, 8), edges(spark, pairs))
    got = {i: {r["target"] for r in p.of(i).collect()} for i in range(8)}
    assert got == sets and p.complete


def test_points_to_overflow(spark):
    pairs = [(i, 10) for i in range(6)] + [(10, 11)]
    p = points_to.analyze(values(spark, 12), edges(spark, pairs), max_set=5)
    s = {r["value"]: (r["n_targets"], r["is_unknown"]) for r in p.sets().collect()}
    assert not p.complete and s[10] == (None, True) and s[11] == (2, False)  # 11 and, of the first round, 10
    q = points_to.analyze(values(spark, 12), edges(spark, pairs), max_set=5, propagate_unknown=True)
    assert {r["value"] for r in q.unknown.collect()} == {10, 11}
    r = points_to.analyze(values(spark, 5), edges(spark, [(i, i + 1) for i in range(4)]), max_rounds=2)
    assert not r.complete
    with pytest.raises(ValueError):
        points_to.analyze(values(spark, 1), edges(spark, [(0, 0)]), "all")


def test_reaching_and_phi(spark):
    """0 defines x, branch 1, 2 redefines x, merge 3, use 4; a loop 4 -> 1."""
    n = spark.createDataFrame([(0, "x", 0, "Statement"), (1, None, None, "Branch"), (2, "x", 2, "Statement"), (3, None, None, "Merge"), (4, None, None, "Statement")], "node_id long, var string, def_id long, kind string")
    e = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    r = dataflow.reaching_definitions(n, e, [])
    got = {}
    for x in r.collect():
        got.setdefault(x["node_id"], set()).add(x["def_id"])
    assert got == {1: {0, 2}, 2: {0, 2}, 3: {0, 2}, 4: {0, 2}}
    phi = dataflow.phi_values(r, dataflow.merge_nodes(n, e, []), []).collect()
    assert [(p["node_id"], p["var"], p["defs"]) for p in phi] == [(3, "x", [0, 2])]
    assert dataflow.reaching_definitions(n.filter("var IS NULL"), e, []).count() == 0


@pytest.mark.parametrize(("text", "name"), [("let x = 1;", "x"), ("let mut y: i32 = 2;", "y"), ("a.b = c;", "a.b"), ("f(x);", None), ("let z;", "z"), ("x == y", None), ("", None), (None, None), ("outlet = 3;", "outlet")])
def test_defined_name(spark, text, name):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(dataflow.defined_name(F.col("s"))).first()[0] == name


def test_defined_name_raw(spark):
    assert spark.range(1).select(dataflow.defined_name(F.lit("let mut x = 1;"), raw=True)).first()[0] == "mut"


def test_lookup(spark):
    scopes = spark.createDataFrame([("f", 0, None), ("f", 1, 0), ("f", 2, 1)], "file_id string, scope_id long, parent_id long")
    symbols = spark.createDataFrame([("f", 5, "x", 0), ("f", 6, "x", 1), ("f", 7, "x", 1), ("f", 8, "y", 0)], "file_id string, symbol_id long, name string, scope_id long")
    names = spark.createDataFrame([("f", 2, "x"), ("f", 0, "x"), ("f", 2, "y"), ("f", 2, "z")], "file_id string, scope_id long, name string")
    got = {(r["scope_id"], r["name"]): r["symbol_id"] for r in dataflow.lookup(names, scopes, symbols).collect()}
    assert got == {(2, "x"): 7, (0, "x"): 5, (2, "y"): 8, (2, "z"): None}
    loop = spark.createDataFrame([("f", 0, 1), ("f", 1, 0)], "file_id string, scope_id long, parent_id long")
    with pytest.raises(RuntimeError):
        dataflow.scope_chain(loop, 5)


def test_changes(spark):
    f = lambda *r: spark.createDataFrame(list(r), "file_id string, content_hash string")
    before, after = f(("a", "1"), ("b", "1"), ("c", "1"), ("e", None)), f(("a", "1"), ("b", "2"), ("d", "1"), ("e", None))
    got = {tuple(r) for r in changes.detect_changes(before, after).collect()}
    assert got == {("a", "Unchanged"), ("b", "Modified"), ("c", "Deleted"), ("d", "Added"), ("e", "Unchanged")}
    assert changes.detect_changes(f(), f()).count() == 0


def test_invalidation(spark):
    a = spark.createDataFrame([(0, 10, 1), (0, 10, 2), (20, 30, 3)], "range_start long, range_end long, node_id long")
    d = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "node_id long, edge_id long")
    w = spark.createDataFrame([(0, 10)], "start long, end long")
    hit = changes.invalidated_nodes(a, w)
    assert sorted(r["node_id"] for r in hit.collect()) == [1, 2]
    assert sorted(r["edge_id"] for r in changes.invalidated_edges(hit, d).collect()) == [10, 11]
    assert tuple(changes.invalidation_stats(a, d).first()) == (2, 3)


@pytest.mark.parametrize("width", [1, 3, 100])
def test_overlap_join_random(spark, width):
    rng = random.Random(width)
    some = lambda: [(s, s + rng.choice([0, 0, 1, 3, 9])) for s in (rng.randrange(40) for _ in range(40))]
    a, b = list(enumerate(some())), list(enumerate(some()))
    left = spark.createDataFrame([(0, i, s, e) for i, (s, e) in a], "k long, i long, range_start long, range_end long")
    right = spark.createDataFrame([(0, j, s, e) for j, (s, e) in b], "k long, j long, start long, end long")
    got = sorted((r["i"], r["j"]) for r in changes.overlap_join(left, right, ["k"], width).collect())
    assert got == sorted((i, j) for i, x in a for j, y in b if (x[1] > y[0] and y[1] > x[0]) or x == y)


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(i, k) for i, k in enumerate(("File", "Function", "Function", "CfgNode"))], "id long, kind string")
    return PropertyGraph(nodes, spark.createDataFrame([(0, "Calls", 1, 2), (1, "Calls", 2, 1), (2, "ControlFlow", 1, 3)], EDGE))


def test_plan_order(small):
    t = [Task(3, FindNodes("File"), 0), Task(1, FindNodes("Function"), 1), Task(2, FollowEdges((2, 1), "Calls"), 2), Task(4, Filter((3, 3, 9), "CfgNode"), 3), Task(5, Intersect((1, 1, 2), (1,)), 4), Task(6, Reachable((1,), 1), 5)]
    plan = ExecutionPlan().add_stage(Stage(t))
    rows = [(r["task_id"], r["id"]) for r in plan.execute(small).orderBy("stage", "commit", "a", "b").collect()]
    assert rows == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 0), (4, 3), (4, 3), (5, 1), (5, 1), (6, 1), (6, 2), (6, 3)]
    assert [x.task_id for x in Stage(t, by_task_id=False).commit_order()][:2] == [3, 1] and plan.task_count() == 6
    assert ExecutionPlan().execute(small).count() == 0


def test_plan_invariants():
    f = FindNodes("File")
    for tasks in ([Task(1, f, 0), Task(2, f, 0)], [Task(1, f, 0), Task(1, f, 1)], [Task(1, f, 0, (2,)), Task(2, f, 1, (1,))], [Task(1, f, 0, (9,))]):
        with pytest.raises(InvariantError):
            ExecutionPlan([Stage(tasks)]).validate()
    ExecutionPlan([Stage([Task(2, f, 1, (1,)), Task(1, f, 0)])]).validate()


def test_cost_and_cache(spark):
    assert QueryCost(100, 2.5, 3, 0.1).estimate() == 675.0
    assert spark.range(1).select(cost(F.lit(100), F.lit(2.5), F.lit(3), F.lit(0.1))).first()[0] == 675.0
    c, df = PlanCache(), spark.range(1)
    c.put({"a": 1, "b": 2}, "h", df)
    assert c.get({"b": 2, "a": 1}, "h") is df and c.get({"a": 1, "b": 2}, "other") is None and len(c) == 1
    c.clear()
    assert len(c) == 0


def test_json_queries(small):
    ids = lambda q: [r["id"] for r in compile_query(small, q).orderBy("seq").collect()]
    assert ids('{"op": "find_nodes", "kind": "Function"}') == [1, 2]
    assert ids({"steps": [{"op": "find_nodes", "kind": "Function"}, {"op": "follow_edge", "kind": "Calls"}]}) == [2, 1]
    assert ids({"op": "intersect", "a": [1, 3, 1], "b": {"op": "find_nodes", "kind": "Function"}}) == [1, 1]
    assert sorted(ids({"op": "reachable_within", "from": 2, "depth": 1})) == [1, 2]
    assert ids({"op": "filter", "ids": [3, 0], "kind": "File"}) == [0]
    for bad in ({"op": "drop"}, {"op": "filter", "ids": [1], "where": 2}, {"op": "filter"}, {"steps": []}, [1], {"op": "filter", "ids": ["x"]}):
        with pytest.raises(QueryError):
            compile_query(small, bad)
