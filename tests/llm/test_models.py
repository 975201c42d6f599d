"""Search, URL filter, quality classifier."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import LONG, table
from weftgraph.llm import quality_classifier as Q
from weftgraph.llm import topk_search, url_filter
from weftgraph.llm.queries import QUERIES


@pytest.mark.parametrize("sizes", [(16_384, 32_000_000), (37, 20_000)])
def test_search_brute(spark, sf_dir, sizes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(3)
    queries = docs.filter("doc_id % 20 = 0")
    got = topk_search.search(docs, queries, k=7, shard_docs=sizes[0], group_bytes=sizes[1])
    every = [tuple(r) for r in docs.collect()]
    want = brute.bm25(every, [x for x in every if x[0] % 20 == 0], k=7)
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    assert have.keys() == want.keys()
    for q in want:
        assert [d for d, _ in have[q]] == [d for d, _ in want[q]]
        assert np.allclose([s for _, s in have[q]], [s for _, s in want[q]], atol=2e-6)


@pytest.mark.parametrize("seed", range(4))
def test_pruning_is_exact(seed):
    """Many documents, short blocks: the visit that stops early finds what the full one does."""
    rng = np.random.default_rng(seed)
    held = []
    for i in range(3000):
        n = int(rng.integers(1, 60))
        t, c = np.unique(rng.zipf(1.3, n).clip(1, 500).astype(np.uint64), return_counts=True)
        held.append((i, t, c.astype(np.int64), n))
    s = topk_search.build_shard(held)
    shard = topk_search.Shard(s["n"], s["ids"], s["lengths"], s["terms"], s["ends"], s["docs"], s["tfs"], 30.0)
    for q in range(0, 3000, 500):
        terms = np.sort(held[q][1])
        idf = np.log(1 + 3000 / (1 + terms.astype(float)))
        (docs, scores), = shard.search([(shard.find(terms), idf)], 10, np.zeros(1))
        full = np.zeros(3000)
        for i, t, c, n in held:
            norm = topk_search.K1 * (1 - topk_search.B + topk_search.B * n / 30.0)
            for w, k in zip(t, c):
                if (j := np.flatnonzero(terms == w)).size:
                    full[i] += idf[j[0]] * k * (topk_search.K1 + 1) / (k + norm)
        order = np.lexsort((np.arange(3000), -np.round(full, 6)))[:10]
        assert np.allclose(scores, full[order], atol=2e-6) and np.allclose(full[shard.ids[docs]], scores, atol=2e-6)


def test_queries_share_products():
    """Queries that stop at the same blocks have them scored together, and find what each finds alone."""
    rng = np.random.default_rng(5)
    held = []
    for i in range(1500):
        n = int(rng.integers(1, 60))
        t, c = np.unique(rng.zipf(1.3, n).clip(1, 500).astype(np.uint64), return_counts=True)
        held.append((i, t, c.astype(np.int64), n))
    s = topk_search.build_shard(held)
    new = lambda: topk_search.Shard(s["n"], s["ids"], s["lengths"], s["terms"], s["ends"], s["docs"], s["tfs"], 30.0)
    shard, idf = new(), lambda t: np.log(1 + 1500 / (1 + t.astype(float)))
    queries = [(shard.find(t), idf(t)) for _, t, _, _ in held[:250]] + [(np.full(1, len(shard.terms)), np.ones(1)), (np.zeros(0, np.int64), np.zeros(0))]
    together = list(shard.search(queries, 10, np.zeros(252)))
    assert shard.products < len(queries) and not len(together[-1][0]) and not len(together[-2][0])
    for q, (docs, scores) in zip(queries[:250:5], together[:250:5]):
        (alone, own), = new().search([q], 10, np.zeros(1))
        assert np.array_equal(alone, docs) and np.array_equal(own, scores)


def test_search_odd(odd, none):
    got = topk_search.search(odd, odd, k=3)
    r = table(got, "query_id", "rank", "doc_id")
    assert (9, 1, 9) in r and (9, 2, 10) in r and (10, 1, 9) in r
    assert not [x for x in r if x[0] in (None, 1, 2, 7)]
    assert topk_search.search(none, none).count() == 0 and topk_search.search(none, odd).count() == 0


def test_search_query(spark, sf_dir):
    r = QUERIES["op1_topk_search"](spark, sf_dir)
    top = {x["query_id"]: x["doc_id"] for x in r.filter("rank = 1").collect()}
    ids = [x["doc_id"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 50 = 0").collect()]
    assert sorted(top) == sorted(ids) and all(d <= q for q, d in top.items())  # itself, or a copy of a smaller id


# --- URLs

URLS = [
    ("http://Example.COM/en/7/x?q=/en/", "example.com", "/en/7/x", "example.com/en/7", "allow"), ("https://a.b.com/en/1", "a.b.com", "/en/1", "com/en/", "block"), ("x://com/en/", "com", "/en/", "com/en/", "block"), ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("http://example.net/de/7", "example.net", "/de/7", "net/de/", "allow"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://a.org/es/?x", "a.org", "/es/", "org/es/", "block"), ("http://a.org/ES/", "a.org", "/ES/", None, None), ("http://telecom/en/", "telecom", "/en/", None, None),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://host", "host", "", None, None), ("http://h#/en", "h", "", None, None), ("http://x.com\n/en/", "x.com\n", "/en/", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0], "kept", "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r["_wg_host"], r["_wg_path"], r["_wg_rule"]) == (host, path, rule), r
        assert r["_wg_verdict"] == verdict if verdict else r["_wg_verdict"] in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    lone = url_filter.judge_urls(df.filter("page_id = 13")).first()
    assert lone["_wg_score"] == 0.0 and lone["_wg_verdict"] == "allow"


def test_whole_url(spark):
    """Query and fragment count, and so does a URL without a scheme."""
    urls = [f"http://a.net/de/{i}?good=yes#fine{i}" for i in range(60)] + [f"http://a.com/en/{i}?casino=spam#win{i}" for i in range(60)]
    asked = ["http://b.org/x?good=yes#fine", "http://b.org/x?casino=spam#win", "a.net/de/7?good=yes", "a.com/en/7?casino=spam"]
    df = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    r = {r["page_id"]: (r["_wg_verdict"], r["_wg_rule"]) for r in url_filter.judge_urls(df).collect()}
    assert [r[120 + i] for i in range(4)] == [("allow", None), ("block", None)] * 2


def test_char_model():
    m = url_filter.CharModel([b"abab", b"abac"])
    for context in (b"", b"a", b"ab", b"zz", b"\x02ab"):
        assert abs(sum(m.prob(context, c) for c in range(256)) - 1) < 1e-9
    f = url_filter.RatioFilter([b"docs.site/%d" % i for i in range(200)], [b"spam-win.biz/%d" % i for i in range(200)])
    assert all(f.score(b"docs.site/x%d" % i) >= f.threshold > f.score(b"spam-win.biz/x%d" % i) for i in range(300, 340))


def brute_url_scores(urls, verdicts, order=5):
    """(mean log-likelihood ratio of each URL, threshold): the models as plain sums over all training URLs.

    Training URLs are distinct, in the order of their XXH64; every fifth calibrates.
    """
    signed = lambda b: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(b, 42))
    classes = {w: sorted({u.encode() for u, v in zip(urls, verdicts) if v == w}, key=lambda b: (signed(b), b)) for w in ("allow", "block")}

    def model(own):
        seen = {}
        for u in own:
            s = b"\x02" + u + b"\x03"
            for i in range(1, len(s)):
                for k in range(min(i, order) + 1):
                    seen.setdefault(s[i - k : i], []).append(s[i])
        seen = {c: (Counter(n), len(n)) for c, n in seen.items()}

        def prob(context, byte):
            p = 1 / 256
            for k in range(len(context) + 1):  # from no context to the whole one
                n, total = seen.get(context[len(context) - k :], (Counter(), 0))
                p = (n[byte] + len(n) * p) / (total + len(n)) if total else p
            return p

        def mean(u):
            s = b"\x02" + u + b"\x03"
            return sum(math.log(prob(s[max(0, i - order) : i], s[i])) for i in range(1, len(s))) / (len(s) - 1)

        return mean

    good, bad = (model([u for i, u in enumerate(classes[w]) if i % 5] or classes[w]) for w in ("allow", "block"))
    held = {w: [good(u) - bad(u) for i, u in enumerate(classes[w]) if not i % 5] for w in classes}
    points = sorted({*held["allow"], *held["block"], 0.0})
    cuts = [(a + b) / 2 for a, b in zip(points, points[1:])]
    wrong = [sum(x < c for x in held["allow"]) / len(held["allow"]) + sum(x >= c for x in held["block"]) / len(held["block"]) for c in cuts]
    threshold = min((c for c, w in zip(cuts, wrong) if math.isclose(w, min(wrong))), key=abs)
    return [good(u.encode()) - bad(u.encode()) for u in urls], threshold


def test_url_query_brute(spark, sf_dir):
    """The registered query row by row: a second implementation of models, threshold and verdict."""
    rows = QUERIES["op6_url_filters"](spark, sf_dir).collect()
    urls = {r["page_id"]: r["url"] or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    scores, threshold = brute_url_scores([urls[r["page_id"]] for r in rows], [r["verdict"] if r["rule"] else None for r in rows])
    assert len(rows) == len(urls) and any(not r["rule"] for r in rows)
    for r, s in zip(rows, scores):
        assert abs(r["score"] - s) < 1e-9
        if not r["rule"] and abs(s - threshold) > 1e-9:
            assert r["verdict"] == ("allow" if s >= threshold else "block")


def test_url_models_take_all(spark):
    """More labelled URLs of a class than any sample: every one of them counts, in models and threshold."""
    urls = [f"http://a.net/de/{i:05d}" for i in range(13_000)] + [f"http://a.com/en/{i:05d}" for i in range(12_500)] + ["http://b.org/11111", "x"]
    r = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    scores, threshold = brute_url_scores(urls, ["allow"] * 13_000 + ["block"] * 12_500 + [None] * 2)
    assert np.allclose([x["_wg_score"] for x in r], scores, rtol=0, atol=1e-9)
    assert [x["_wg_verdict"] for x in r[-2:]] == ["allow" if s >= threshold else "block" for s in scores[-2:]]


def test_url_query(spark, sf_dir):
    r = QUERIES["op6_url_filters"](spark, sf_dir)
    assert r.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    ruled = r.filter("rule IS NOT NULL").withColumn("own", F.when(F.col("score") > 0, "allow").otherwise("block"))
    right = ruled.filter("own = verdict").count() / ruled.count()
    assert right > 0.9 and table(r, *r.columns) == table(QUERIES["op6_url_filters"](spark, sf_dir), *r.columns)


# --- quality


def test_ordinal_model():
    rng = np.random.default_rng(0)
    make = lambda g: (np.unique(np.r_[rng.integers(100, 1000, 20), [g] * 1]), None)[0]
    grade = np.array([i % 3 for i in range(600)])
    data = [(i := make(g), np.ones(len(i))) for g in grade]
    keep = Q.screened(data, grade, 10)
    assert set(np.flatnonzero(keep)) >= {0, 1, 2} and keep.sum() < 40
    cut = lambda x: (x[0][keep[x[0]]], x[1][keep[x[0]]])
    m = Q.OrdinalModel(10).fit([cut(x) for x in data], grade)
    assert m.cuts[0] <= m.cuts[1]
    tails = np.array([m.grades(*cut(x)) for x in data])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails > 0.5).sum(1) == grade).mean() > 0.95


def brute_features(text, bits=18):
    """{(part, number): value}: words by 1 + log of their count, marks and case by eight times their share."""
    words = [w for w in re.split(r"[ \t\n\r\f\v]+", text or "") if w]
    number = lambda b: xxhash.xxh64_intdigest(b) % (1 << bits)
    count, share = Counter(), Counter()
    for w in words:
        raw = w.encode()
        core = re.sub(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$", b"", raw)
        count[number(b"w " + core.lower())] += 1
        share[number(b"m " + re.search(rb"[#*$%&|<>!?.,;:]*$", raw).group())] += 1
        share[number(b"upper")] += len(core) > 1 and core.isupper()
    return {("w", k): 1 + math.log(n) for k, n in count.items()} | {("s", k): 8 * n / len(words) for k, n in share.items() if n}


def brute_grades(labelled, texts):
    """Expected grades by plain sums: screen, fit and score again, document by document."""
    data = [(brute_features(t), g) for _, t, g in sorted(labelled)]
    df, above, keep = Counter(), [Counter(), Counter()], set()
    for f, g in data:
        for k in {k for _, k in f}:
            df[k] += 1
            for j in range(g):
                above[j][k] += 1
    for k, n in df.items():
        for j in range(2):
            p = sum(g > j for _, g in data) / len(data)
            spread = math.sqrt(max(n * p * (1 - p) * (1 - n / len(data)), 1e-9))
            if n >= 4 and spread > 1e-3 and abs(above[j][k] - n * p) >= 4 * spread:
                keep.add(k)
    w, g2, cuts, cut2 = Counter(), {k: 1e-2 for k in keep}, [-0.5, 0.5], [1.0, 1.0]
    held = Counter(g for _, g in data)
    weight = [math.sqrt(len(data) / max(1, held[g]) / 3) for g in range(3)]
    logistic = lambda x: 1 / (1 + math.exp(min(30, max(-30, x))))
    rng = np.random.default_rng(7)
    rows = [([(k, v) for (_, k), v in f.items() if k in keep], g) for f, g in data]
    assert all(len({k for k, _ in r}) == len(r) for r, _ in rows)  # no word shares its number with a mark here
    for _ in range(20):
        for i in rng.permutation(len(rows)):
            f, y = rows[i]
            score = sum(w[k] * v for k, v in f)
            full = [0.0, *(logistic(score - c) for c in cuts), 1.0]
            slope = [x * (1 - x) for x in full]
            p = max(full[y + 1] - full[y], 1e-9)
            up = weight[y] * (slope[y + 1] - slope[y]) / p
            for k, v in f:
                grad = up * v + 1e-5 * w[k]
                g2[k] += grad * grad
                w[k] -= 0.1 * grad / math.sqrt(g2[k])
            step = [0.0, 0.0]
            if y < 2:
                step[y] -= weight[y] * slope[y + 1] / p
            if y:
                step[y - 1] += weight[y] * slope[y] / p
            for j in range(2):
                cut2[j] += step[j] ** 2
            cuts = [c - 0.1 * s / math.sqrt(q) for c, s, q in zip(cuts, step, cut2)]
            cuts[1] = max(cuts)
    return [sum(logistic(c - sum(w[k] * v for (_, k), v in brute_features(t).items())) for c in cuts) for t in texts]


def test_classifier_query_brute(spark):
    """The registered query row by row, on one hundredth of the documents: a second implementation of features, screen, fit and score."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").dropna().collect()}
    got = {r["doc_id"]: r for r in QUERIES["op8_quality_classifier"](spark, sf).collect()}
    want = brute_grades([(i, docs[i], 0 if r["toxic"] else 1 + (r["quality"] > 0)) for i, r in labels.items() if i in docs], docs.values())
    assert len(got) == len(docs)
    assert max(abs(got[i]["expected_grade"] - g) for i, g in zip(docs, want)) < 1e-4


def test_long_texts_count_whole(spark):
    """A text of 30,000 distinct words keeps its marks and case, in fitting and in scoring alike."""
    long = " ".join(f"w{i}" for i in range(30_000)) + " END! SHOUT!"
    idx, val = Q.Features()(long)
    want = brute_features(long)
    assert sorted(zip(idx.tolist(), val.round(9).tolist())) == sorted((k, round(v, 9)) for (_, k), v in want.items())
    some = Q.Features().table(pa.array(["a b", None, "", long, "B! c"]), None)
    assert sorted(set(some[0].tolist())) == [0, 3, 4] and (some[0] == 3).sum() == len(idx)


def test_held_out(spark):
    """Trained on even ids, judged on odd ones."""
    top = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{top}/labels.parquet")
    docs = spark.read.parquet(f"{top}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    got = Q.grade_documents(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    share = lambda mask: got[mask]["kept"].mean()
    assert share((got.quality == 1) & (got.toxic == 0)) > 0.97
    assert share(got.toxic == 1) < 0.06
    assert share((got.quality == 0) & (got.toxic == 0)) < 0.4


def test_classifier_odd(odd, none):
    labels = odd.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    got = Q.grade_documents(odd, labels)
    assert got.count() == odd.count() and Q.grade_documents(none, labels).count() == 0
    assert len({r["expected_grade"] for r in got.collect()}) == 1  # no label is whole
    empty = Q.Features()("")
    assert len(empty[0]) == 0 and len(Q.Features()(LONG)[0]) > 900
