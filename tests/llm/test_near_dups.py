"""SimHash, tiles, components."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import LONG, rows, table
from weftgraph.llm import simhash_dedup as S
from weftgraph.llm.components import components
from weftgraph.llm.queries import QUERIES


def test_fingerprint():
    for t in (None, "", "one", "One two THREE", "a b c d e f g a b c d É é", "\x1cx\u00a0y", LONG[:20000]):
        assert S.fingerprint(t, 4) == [brute.fingerprint(t, 4)] and S.fingerprint(t, 5, 3)[0] == brute.fingerprint(t, 5)
    assert S.fingerprint("", 4, 4) == [0] * 4 and len(set(S.fingerprint("a b c d e f", 2, 4))) == 4


@pytest.mark.parametrize("seed", range(3))
def test_linked_random(seed, monkeypatch):
    """Forests have the components of all links, for any block size; groups are dense."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(12)]
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
    w = list({flip(rng.choice(bases)) if rng.random() < 0.6 else rng.getrandbits(64) for _ in range(200)})
    rowed = lambda x: np.array([[v, v] for v in x], np.uint64)
    cut = len(w) // 3
    signed = [int(np.uint64(v).astype(np.int64)) for v in w]
    edges = S.linked(rowed(w), None, 4, 4)
    assert len(edges) < len(w)
    want = brute.groups(len(w), lambda i, j: (w[i] ^ w[j]).bit_count() <= 4)
    assert classes(signed, edges) == classes(signed, [(signed[i], signed[r]) for i, r in enumerate(want)])
    parts = S.linked(rowed(w[:cut]), None, 4, 4) + S.linked(rowed(w[cut:]), None, 4, 4) + S.linked(rowed(w[:cut]), rowed(w[cut:]), 4, 4)
    assert classes(signed, parts) == classes(signed, edges)


def classes(nodes, edges):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_wide_links():
    a = np.array([[1, 0, 0], [2, 1, 0xFFFF], [3, 1, 1]], np.uint64)
    assert S.linked(a, None, 4, 6) in ([(3, 1)], [(1, 3)])


def test_bands():
    counts = {20: 5, 21: 100, 22: 3, 30: 4, 31: 250}
    assert S._bands(counts, 50) == [(20, 21, 3), (22, 31, 6)] and S._bands({}, 5) == [] and S._bands({7: 2}, 5) == [(7, 7, 1)]


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    pairs = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "chain": [(i, i + 1) for i in range(40)], "star": [(99, i) for i in range(30)], "none": [(3, 3)]}[shape]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = classes({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("tile_factor", [1, 40])
def test_query_brute(spark, sf_dir, tile_factor):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = S.near_groups(docs, shingle=4, words=1, radius=4, tile_factor=tile_factor)
    d = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fp = [brute.fingerprint(t, 4) for _, t in d]
    comp = brute.groups(len(d), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    want = [(i, f - (1 << 64) if f >> 63 else f, d[c][0]) for (i, _), f, c in zip(d, fp, comp)]
    assert sorted((r["_wg_id"], r["_wg_words"][0], r["_wg_component"]) for r in got.collect()) == want


def test_query_columns(spark, sf_dir):
    r = QUERIES["op5_simhash_dedup"](spark, sf_dir).first()
    assert len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"]


def test_odd(odd, none):
    got = S.near_groups(odd, words=1, radius=4)
    assert got.count() == odd.count()
    by = {(r["_wg_id"], r["_wg_words"][0]): r["_wg_component"] for r in got.collect()}
    assert by[1, 0] == by[2, 0] == by[7, 0] == by[None, 0] == 1 and by[10, S.fingerprint("one", 5)[0]  - (1 << 64) if S.fingerprint("one", 5)[0] >> 63 else S.fingerprint("one", 5)[0]] == 9
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 4, 8, 9, 11} <= set(ids) and not {2, 5, 6, 7, 10} & set(ids)
    assert S.keep_one(none).count() == 0 and S.near_groups(none).count() == 0


def test_similarity(spark, none):
    """Texts that share over nine in ten five-word shingles meet; unrelated ones stay."""
    rng = random.Random(2)
    texts = []
    for k in range(12):
        w = [f"t{k}n{rng.randrange(900)}" for _ in range(400)]
        near = list(w)
        near[rng.randrange(400)] = "changed"
        near[rng.randrange(400)] = "altered"
        texts += [w, near]
    docs = spark.createDataFrame(rows([(i, " ".join(t), "s") for i, t in enumerate(texts)]), none.schema)
    assert table(S.keep_one(docs), "doc_id") == [(i,) for i in sorted(range(0, 24, 2), key=lambda x: repr((x,)))]
    assert S.similarity_radius(0.8, 256) == 39 and S.similarity_radius(1.0, 256) == 0


def planted(rng, name, shingles, changes):
    """Two texts of unlike words whose sets of five-word shingles share all but 5 * changes each."""
    w = [f"{name}n{i}x{rng.randrange(10**6)}" for i in range(shingles + 4)]
    near = list(w)
    for k in range(changes):
        near[5 + k * (shingles // changes)] = f"{name}changed{k}"
    return [" ".join(w), " ".join(near)]


def test_similarity_border(spark, none):
    """Pairs at a Jaccard similarity of 0.80 to 0.85 meet, all of them; pairs at 0.70 to 0.79 stay apart."""
    rng = random.Random(3)
    near = [t for k in range(60) for t in planted(rng, f"a{k}", *((180, 4), (190, 4), (330, 6))[k % 3])]  # 0.80, 0.81, 0.83
    far = [t for k in range(60) for t in planted(rng, f"b{k}", *((175, 4), (160, 4), (120, 4))[k % 3])]  # 0.79, 0.78, 0.71
    docs = spark.createDataFrame(rows([(i, t, "s") for i, t in enumerate(near + far)]), none.schema)
    got = {r["_wg_id"]: r["_wg_component"] for r in S.near_groups(docs).collect()}
    assert [i for i in range(0, 120, 2) if got[i + 1] != i] == [] and all(got[i] == i for i in range(120, 240))


@pytest.mark.parametrize(("shingles", "changes"), [(46, 1), (60, 1), (92, 2), (184, 4), (920, 20)])
def test_recall_by_length(spark, none, shingles, changes):
    """Of 80 pairs just above the similarity at least nine in ten meet, whatever their length; all copies beside them do."""
    rng = random.Random(shingles)
    texts = [t for k in range(80) for t in planted(rng, f"s{shingles}k{k}", shingles, changes)]
    assert 0.8 <= (shingles - 5 * changes) / (shingles + 5 * changes) < 0.86
    docs = spark.createDataFrame(rows([(i, t, "s") for i, t in enumerate(texts)] + [(1000, texts[0], "s")]), none.schema)
    got = {r["_wg_id"]: r["_wg_component"] for r in S.near_groups(docs).collect()}
    assert sum(got[i + 1] == i for i in range(0, 160, 2)) >= 76 and got[1000] == 0
    assert all(got[i] == i for i in range(0, 160, 2))


def test_repeated_shingles(spark, none):
    """Similarity is one of sets: how often a shingle repeats does not count."""
    own = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame(rows([(1, own, "s"), (2, own + " " + " ".join(["w0 w1 w2 w3 w4 w5"] * 60), "s")]), none.schema)
    sets = [set(S.shingle_hashes(r["text"], 5).tolist()) for r in docs.collect()]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) and S.keep_one(docs).count() == 1


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_similarity_brute(spark, none, chunk, monkeypatch):
    """Chains of ever more changed texts, in one chunk and in many: the classes of all pairs."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "CHUNK_FACTOR", 1)
    rng, texts = random.Random(4), []
    for k in range(4):
        w = [f"c{k}w{i}" for i in range(150)]
        for step in range(12):
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(150)] = f"c{k}s{step}r{rng.randrange(10**6)}"
            texts.append(" ".join(w[: 150 - 2 * (step % 3)]))
    docs = spark.createDataFrame(rows([(i, t, "s") for i, t in enumerate(texts)]), none.schema)
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    want = brute.groups(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert 4 < len(set(want)) < 48
    assert sorted((r["_wg_id"], r["_wg_component"]) for r in S.near_groups(docs, tile_factor=1).collect()) == list(enumerate(want))


def test_keep_one_ids(spark, none):
    """One row a group, whatever the ids: null, repeated, or those of a near copy and of another text."""
    text = lambda k: " ".join(f"k{k}w{i}" for i in range(120))
    near = lambda k: text(k) + " more"
    pairs = [(None, text(1)), (None, text(2)), (None, text(2)), (None, near(3)), (5, text(3)), (None, text(4)), (6, text(5)), (6, text(6)), (5, text(7)), (7, text(8)), (8, near(8)), (8, text(9)), (None, near(9))]
    docs = spark.createDataFrame(rows([(i, t, "s") for i, t in pairs]), none.schema)
    left = lambda **o: table(S.keep_one(docs, **o), "doc_id", "text")
    want = [(None, text(1)), (None, text(2)), (5, text(3)), (None, text(4)), (6, text(5)), (6, text(6)), (5, text(7)), (7, text(8)), (8, text(9))]
    assert left(unique_ids=False) == sorted(want, key=repr)
    one = left()
    assert set(one) <= set(want) and [i for i, _ in one].count(None) == 3 and sorted(i for i, _ in one if i) == [5, 6, 7, 8]
