"""Mixing, resharding, packing."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import table
from weftgraph.llm import packing, resharding, source_mixing
from weftgraph.llm.queries import QUERIES


def sized(df):
    return source_mixing._rows(df, "doc_id", "source", "text")


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"x": 3}, {"a": 0, "b": 4}, {chr(97 + i): 3**i for i in range(9)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "_wg_source string, _wg_size long")
    got = {r["_wg_source"]: r["_wg_target"] for r in source_mixing.source_targets(df).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in got)
    assert all(got[k] <= 3 * sizes[k] + 1e-9 for k in got)


@pytest.mark.parametrize("which", ["some", "odd"])
def test_schedule_brute(request, which):
    rows = sized(request.getfixturevalue(which))
    got = source_mixing.schedule(rows)
    want = brute.mixing([(r["_wg_id"], r["_wg_source"], r["_wg_size"]) for r in rows.collect()])
    assert table(got, "_wg_id", "_wg_source", "_wg_size", "_wg_copies") == sorted(want, key=repr)


def test_schedule_properties(spark, sf_dir):
    r = QUERIES["op2_source_mixing"](spark, sf_dir)
    rows = r.collect()
    assert sum(x["taken"] for x in rows) <= sum(x["size"] for x in rows) and all(x["taken"] in (0, x["size"], 2 * x["size"], 3 * x["size"]) for x in rows)
    taken, goal, most = Counter(), {}, Counter()
    for x in rows:
        key = (x["source_size"], x["target"])
        taken[key] += x["taken"]
        goal[key], most[key] = x["target"], max(most[key], x["size"])
    assert all(abs(taken[k] - goal[k]) <= 2 * max(most.values()) for k in goal)
    assert table(r, *r.columns) == table(QUERIES["op2_source_mixing"](spark, sf_dir), *r.columns)


def test_mix(odd, none):
    got = source_mixing.mix(odd)
    assert got.columns == odd.columns and got.count() > 0 and source_mixing.mix(none).count() == 0
    n = Counter(r["doc_id"] for r in got.collect())
    assert max(n.values()) <= 6 and n[4] != 1  # the repeated rows of 4 go together


@pytest.mark.parametrize("texts", [[("a", None), ("a", ""), ("b", "one two three")], [("a", None)], [("a", ""), (None, " "), ("b", None)]])
def test_sources_without_words(spark, tmp_path, texts):
    """A source without words has the target 0: its rows are scheduled, and never taken."""
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "doc_id long, source string, text string")
    got = source_mixing.schedule(sized(docs))
    want = brute.mixing([(r["_wg_id"], r["_wg_source"], r["_wg_size"]) for r in sized(docs).collect()])
    assert table(got, "_wg_id", "_wg_source", "_wg_size", "_wg_copies") == sorted(want, key=repr)
    assert [r["text"] for r in source_mixing.mix(docs).collect()] == [t for _, t in texts if brute.words(t)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op2_source_mixing"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and all(r["taken"] == r["size"] for r in rows)


# --- resharding


def test_flow_random():
    """Against the closed form of unit costs: what stays is min(old, capacity)."""
    rng = random.Random(1)
    for _ in range(30):
        n, m = rng.randrange(1, 6), rng.randrange(1, 7)
        supply = [rng.randrange(0, 50) for _ in range(n)]
        room = resharding.equal_capacities(sum(supply), m)
        cost = [[int(i != j) for j in range(m)] for i in range(n)]
        f = resharding.min_cost_flow(supply, room, cost)
        assert [sum(r) for r in f] == supply and [sum(c) for c in zip(*f)] == room
        assert sum(f[i][i] for i in range(min(n, m))) == sum(min(a, b) for a, b in zip(supply, room))


def test_flow_costs():
    assert resharding.min_cost_flow([3, 2], [2, 3], [[5, 1], [1, 9]]) == [[0, 3], [2, 0]]
    assert resharding.min_cost_flow([2, 2], [1, 5], [[0, 3], [1, 1]]) == [[1, 1], [0, 2]]
    assert resharding.min_cost_flow([], [1], []) == []
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [2, 2], [[0, 1]])


def test_reshard_query(spark, sf_dir):
    r = QUERIES["op7_flow_resharding"](spark, sf_dir)
    rows = r.collect()
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(x["doc_id"] for x in rows) == sorted(docs)
    sizes, slots, old = Counter(), defaultdict(list), Counter()
    for x in rows:
        raw = (docs[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[x["shard"]] += x["size"]
        old[x["old_shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert set(sizes) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    most, mean = max(x["size"] for x in rows), sum(sizes.values()) / 8
    assert all(abs(s - mean) <= 6 * most for s in sizes.values())
    stays = sum(x["size"] for x in rows if x["shard"] == x["old_shard"])
    assert stays >= sum(min(s, mean) for s in old.values()) - 8 * most
    assert table(r, *r.columns) == table(QUERIES["op7_flow_resharding"](spark, sf_dir), *r.columns)


def test_reshard_odd(odd, none):
    old = F.pmod(F.xxhash64("source"), F.lit(3))
    got = resharding.reshard(resharding.as_rows(odd, old), 2, 3)
    assert got.count() == odd.count() and {r["_wg_size"] for r in got.filter("_wg_id IN (1, 2)").collect()} == {1}
    assert resharding.reshard(resharding.as_rows(none, old), 2, 3).count() == 0


def test_rewrite(spark, some, tmp_path):
    docs = some.select("doc_id", "text", F.when(F.col("doc_id") < 150, 0).otherwise(1).alias("shard"))
    docs.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    changed = resharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), 3)
    assert 0 in changed and 2 in changed
    new = spark.read.parquet(str(tmp_path / "new"))
    keep = docs.filter(~F.col("shard").isin(changed))
    assert table(new.select("doc_id", "text").union(keep.select("doc_id", "text")), "doc_id", "text") == table(docs, "doc_id", "text")


# --- packing


def replay(items, capacity):
    """Every placement must take the tightest bin without conflict, and a new one only if there is none."""
    size_of = {i[0]: i for i in items}
    room, groups = [], []
    for row, piece, b, offset, size in packing.pack_items(items, capacity):
        _, _, source, cluster = size_of[row]
        fits = [room[k] for k in range(len(room)) if room[k] >= size and not {("s", source), ("c", cluster)} & groups[k]]
        if b == len(room):
            assert not fits
            room.append(capacity)
            groups.append(set())
        else:
            assert room[b] == min(fits) and not {("s", source), ("c", cluster)} & groups[b]
        assert offset == capacity - room[b]
        room[b] -= size
        groups[b] |= {("s", source), ("c", cluster)}
        yield row, piece, size


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = random.Random(seed)
    hot = seed % 2
    items = [(i, rng.choice([rng.randrange(1, 30), rng.randrange(1, 400)]), "hot" if hot and rng.random() < 0.4 else f"s{rng.randrange(40)}", rng.choice([0, rng.randrange(100, 10_000)]) if hot else rng.randrange(300)) for i in range(500)]
    pieces = defaultdict(int)
    for row, _, size in replay(items, 100):
        pieces[row] += size
    assert dict(pieces) == {i: n for i, n, _, _ in items}


def test_pack(odd, none, some):
    for docs in (odd, some):
        got = packing.pack(docs, capacity=50, per_packer=40)
        r = got.collect()
        want = Counter()
        for x in docs.collect():
            want[x["doc_id"]] += len(brute.words(x["text"]))
        have = Counter()
        for x in r:
            have[x["id"]] += x["size"]
        assert have == want
        used, members = Counter(), defaultdict(list)
        for x in r:
            assert (x["bin"] is None) == (x["size"] == 0)
            if x["bin"] is not None:
                used[x["bin"]] += x["size"]
                members[x["bin"]].append(x)
        assert max(used.values()) <= 50
        for m in members.values():
            assert len({x["source"] for x in m}) == len(m) and len({x["cluster"] for x in m}) == len(m)
            spans = sorted((x["offset"], x["offset"] + x["size"]) for x in m)
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
    assert packing.pack(none).count() == 0
    assert table(packing.pack(some), "id", "piece", "bin", "offset") == table(packing.pack(some.repartition(5)), "id", "piece", "bin", "offset")


def test_pack_query(spark, sf_dir):
    """The registered query row by row: every document whole, and each piece in the tightest bin that was open to it."""
    got = QUERIES["op10_best_fit_packing"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    have = Counter()
    for x in got:
        have[x["doc_id"]] += x["size"]
    assert have == {i: len(brute.words(t)) for i, t in docs.items()}
    capacity, room, groups = packing.CAPACITY, {}, defaultdict(set)
    items = sorted((x for x in got if x["size"]), key=lambda x: x["doc_id"])
    whole = sorted((x for x in items if x["size"] == capacity), key=lambda x: (x["doc_id"], x["piece"]))
    for x in whole + sorted((x for x in items if x["size"] < capacity), key=lambda x: -x["size"]):
        own = {("s", x["source"]), ("c", x["cluster"])}
        fits = [room[b] for b in room if room[b] >= x["size"] and not own & groups[b]]
        assert room[x["bin"]] == min(fits) and not own & groups[x["bin"]] if x["bin"] in room else not fits
        room.setdefault(x["bin"], capacity)
        assert x["offset"] == capacity - room[x["bin"]]
        room[x["bin"]] -= x["size"]
        groups[x["bin"]] |= own
