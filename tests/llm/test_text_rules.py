"""Quality rules, line dedup and sentence spans."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import LONG, rows, table
from tests.oracle import check, connect
from weftgraph.llm import common, line_dedup, quality_rules, substring_dedup
from weftgraph.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op1_topk_search", "op2_source_mixing", "op3_quality_rules", "op4_line_dedup"])
def test_against_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


def test_rules_counts(odd, some):
    for docs in (odd, some):
        for r in quality_rules.judge(docs).collect():
            w = brute.words(r["text"])
            lines = [x for x in (r["text"] or "").split("\n") if brute.words(x)]
            assert r["_wg_n_words"] == len(w) and r["_wg_word_chars"] == sum(map(len, w))
            assert r["_wg_n_symbols"] == sum(c in "#*$%&|<>" for c in r["text"] or "")
            assert r["_wg_n_dup_lines"] == len(lines) - len(set(lines))
            assert r["_wg_n_repeat_words"] == brute.repeat_words(r["text"])
            failed = len(w) < 10 or 100 * brute.repeat_words(r["text"]) > 20 * len(w)
            assert r["_wg_base_failed"] == failed and not (failed and r["_wg_kept"])


def test_rules_filter(spark, none):
    clean = "This is the text of a page that has some words in it, and it is as plain as the others are."
    texts = [clean, "### $$$ *** " + clean.replace(" ", " ### "), clean.upper(), "- a\n" * 50, clean + " " + clean]
    docs = spark.createDataFrame(rows([(i, t, "s") for i, t in enumerate(texts)]), none.schema)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and table(kept, "doc_id") == [(0,)]
    assert quality_rules.keep_good(none).count() == 0
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert kept._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == plan.count("regexp_extract_all") == 1  # words and metrics once, filtered or not


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (3, 4)])
def test_line_dedup_brute(some, batches, fanout):
    got = line_dedup.dedup_lines(some, batches=batches, fanout=fanout)
    want = brute.line_dedup([(r["doc_id"], r["text"]) for r in some.collect()])
    assert table(got, "doc_id", "_wg_n_lines", "_wg_n_dropped", "text") == sorted(want, key=repr)


def test_line_dedup_odd(odd, none):
    got = line_dedup.dedup_lines(odd, batches=3)
    assert got.columns == [*odd.columns, "_wg_n_lines", "_wg_n_dropped"]
    want = brute.line_dedup([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert table(got, "doc_id", "_wg_n_lines", "_wg_n_dropped", "text") == sorted(want, key=repr)
    assert line_dedup.dedup_lines(none).count() == 0


def test_runs_are_dropped(spark, some):
    line_dedup.dedup_lines(some, batches=2)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weft_run")]


def test_sorted_runs_compaction(spark):
    runs = line_dedup.SortedRuns(spark, buckets=2, fanout=2)
    key = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("_wg_k1"), F.col("id").alias("_wg_k2"), F.col("id").alias("_wg_owner"))
    for i in range(5):
        runs.add(key(10 * i, 10 * i + 10))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # binary: five runs are one of 1 and one of 4
    seen = runs.resolve(key(45, 55).drop("_wg_owner"))
    assert sum(r["_wg_seen"] is not None for r in seen.collect()) == 5
    runs.drop()


def test_sorted_runs_lie_in_order(spark):
    """One file a bucket, also after compactions; no exchange and no sort above a run, in a batch's join or in a merge."""
    runs = line_dedup.SortedRuns(spark, buckets=3, fanout=2)
    key = lambda lo, hi: spark.range(lo, hi).select(F.xxhash64("id").alias("_wg_k1"), F.col("id").alias("_wg_k2"), F.col("id").alias("_wg_owner"))
    for i in range(3):
        runs.add(key(100 * i, 100 * i + 100))
    names = [x for level in runs.levels for x in level]
    assert len(names) == 2 and all(len(spark.table(x).inputFiles()) == 3 for x in names)
    with runs.reading():
        plan = runs.resolve(key(50, 320).groupBy("_wg_k1", "_wg_k2").agg(F.count("*")))._jdf.queryExecution().executedPlan().toString()
        x, y = (spark.table(n) for n in names)
        merge = x.join(y.hint("merge"), list(line_dedup.KEYS), "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("+- *") and plan.count(" Sort [") == 1
    assert merge.count("SortMergeJoin") == 1 and "Exchange" not in merge and " Sort [" not in merge
    runs.drop()


def test_long_blank_run(spark):
    df = spark.createDataFrame([("\x0b a" + " " * 1_000_000 + "b \r",), ("\x1c x\u00a0",), ("",), (None,)], "t string").select(common.strip_ascii(F.col("t")).alias("t"))
    began = time.time()
    got = [r["t"] for r in df.collect()]
    assert time.time() - began < 5 and got == ["a" + " " * 1_000_000 + "b", "\x1c x\u00a0", "", None]


# --- sentence spans


def test_sentences_cover_text():
    for t in (b"", b"A b. C d! E\n\nF... g.h? x", LONG[:5000].encode(), b".", b"\n", "é. ü\u2003. b".encode()):
        s = substring_dedup.sentences(t)
        assert b"".join(t[a:b] for a, b in s) == t and all(a < b for a, b in s)
    assert [t[a:b] for t in [b"One. Two! three?\nFour"] for a, b in substring_dedup.sentences(t)] == [b"One. ", b"Two! ", b"three?\n", b"Four"]


def brute_units(text):
    """(text, words) of sentences, those of over 16 words cut after each word of a hash divisible by 6, three words on at least."""
    out = []
    for a, b in substring_dedup.sentences(text.encode()):
        sentence = text.encode()[a:b].decode()
        words = re.findall(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+[ \t\n\r\f\v]*", sentence)
        low = [w.strip(" \t\n\r\f\v").translate(brute.LOWER) for w in words]
        if len(words) <= 16:
            out.append((sentence, low))
            continue
        held = 0
        for k in range(1, len(words) + 1):
            if k == len(words) or (k - held >= 3 and zlib.crc32(low[k - 1].encode()) % 6 == 0):
                out.append(("".join(words[held:k]), low[held:k]))
                held = k
    return out


def brute_spans(text):
    """Fewest units from each start on that make two units and 28 words, or 50 words."""
    s = [low for _, low in brute_units(text)]
    out = []
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            n = sum(map(len, s[i:j]))
            if (j - i >= 2 and n >= 28) or n >= 50:
                out.append((i, j - i, " ".join(w for x in s[i:j] for w in x).encode()))
                break
    return out


def test_units_cover_text():
    texts = ["", "A b. C d! E", " \n" + " ".join(f"w{i}" for i in range(200)) + ".  End. x", LONG[:5000], "\t \n"]
    for t in texts:
        raw = t.encode()
        u = substring_dedup.units(raw)
        assert b"".join(raw[a:b] for a, b, _, _ in u) == raw
        assert [(raw[a:b].decode(), w.decode().split()) for a, b, _, w in u] == brute_units(t) and all(n == len(w.split()) for _, _, n, w in u)
    assert len(substring_dedup.units(texts[2].encode())) > 20


def test_spans_brute(some):
    import xxhash

    texts = [r["text"].replace("\n", ". ") for r in some.collect()] + ["x " * 60 + ". y.", "Aa. " * 60, "", " ".join(f"w{i % 50}" for i in range(300))]
    for t in texts:
        want = [(i, n, xxhash.xxh3_128_digest(b)) for i, n, b in brute_spans(t)]
        got = substring_dedup.spans(t.encode())
        assert [(i, n, h) for i, n, _, _, h in got] == want
        cut = [x for x, _ in brute_units(t)]
        assert [t.encode()[a:b].decode() for _, _, a, b, _ in got] == ["".join(cut[i : i + n]) for i, n, _ in want]
        assert all(x[2] < y[2] and x[3] <= y[3] for x, y in zip(got, got[1:]))


def brute_removal(docs):
    """[(id, units removed, kept text)] with the first of equal spans kept."""
    place = {}
    for i, t in sorted(docs):
        for at, n, b in brute_spans(t or ""):
            place.setdefault(b, (i, at))
    out = []
    for i, t in docs:
        s = brute_units(t or "")
        gone = {k for at, n, b in brute_spans(t or "") if place[b] != (i, at) for k in range(at, at + n)}
        out.append((i, len(gone), t if not gone else "".join(x for k, (x, _) in enumerate(s) if k not in gone), sum(len(s[k][1]) for k in gone)))
    return out


def test_span_dedup(spark, some, odd, none):
    docs = some.withColumn("text", F.repeat(F.replace("text", F.lit("\n"), F.lit(". ")), 3))
    got = substring_dedup.remove_repeats(docs)
    want = brute_removal([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(x[1] > 0 for x in want) > 50
    assert table(got, "doc_id", "_wg_n_removed", "text", "_wg_words_removed") == sorted(want, key=repr)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert substring_dedup.remove_repeats(odd).count() == odd.count() and substring_dedup.remove_repeats(none).count() == 0


def test_span_query_brute(spark, sf_dir):
    """The registered query row by row."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(i, n, hashlib.sha256((t or "").encode()).hexdigest(), words) for i, n, t, words in brute_removal(docs)]
    assert table(QUERIES["op9_sentence_span_dedup"](spark, sf_dir), "doc_id", "n_removed", "kept_sha256", "n_words_removed") == sorted(want, key=repr)


@pytest.mark.parametrize("marks", [True, False])
def test_passage_cut_anywhere(spark, none, marks):
    """Passages of 60 words that begin and end within a sentence, in lines with and without end marks: most of each goes."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    prose = lambda n: " ".join(word() + (". " if marks and k % 14 == 13 else "") for k in range(n))
    texts, gone = [], 0
    for _ in range(60):
        passage = prose(60)
        texts += [f"{prose(33)} {passage} {prose(21)}", f"{prose(18)} {passage} {prose(40)}"]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows([(i, t, "s") for i, t in enumerate(texts)]), none.schema)).collect()}
    assert all(got[i]["_wg_words_removed"] == 0 for i in range(0, 120, 2)) and all(got[i]["_wg_words_removed"] <= 60 for i in range(1, 120, 2))
    gone = [got[i]["_wg_words_removed"] for i in range(1, 120, 2)]
    assert sum(g >= 30 for g in gone) >= 57 and sum(gone) > 0.7 * 60 * 60


def test_planted_passage(spark, none):
    own = lambda k: " ".join(f"Own{k}x{i} begins a sentence that nobody else has written here." for i in range(6))
    passage = " ".join(f"Shared{i} is a sentence of the passage that many pages carry." for i in range(6))
    texts = [own(0) + " " + passage + " " + own(1), own(2), own(3) + "\n" + passage.upper().replace(" ", "  ") + "\n" + own(4)]
    docs = spark.createDataFrame(rows([(i, t, "s") for i, t in enumerate(texts)]), none.schema)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == texts[1]
    assert got[2]["text"] == own(3) + "\n" + own(4) and got[2]["_wg_words_removed"] == len(passage.split())
    (start, end), = got[2]["_wg_removed"]
    assert texts[2][start:end].split() == passage.upper().split()


def test_kept_hash_of_query(spark, sf_dir):
    r = QUERIES["op9_sentence_span_dedup"](spark, sf_dir).collect()
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    same = [x for x in r if not x["n_removed"]]
    assert len(r) == len(texts) and all(x["kept_sha256"] == hashlib.sha256(texts[x["doc_id"]].encode()).hexdigest() for x in same)
    assert any(x["n_removed"] for x in r)


def test_span_rows_carry_no_hash(spark, odd, monkeypatch):
    """Only rows whose id repeats are told apart by a hash of their text; the result is as with hashes everywhere."""
    named = substring_dedup._named(odd, "doc_id", "text").select("_wg_id", "_wg_row").collect()
    repeated = {k for k, n in Counter(r["_wg_id"] for r in named).items() if n > 1}
    assert repeated == {4, substring_dedup.LAST_ID} and all((r["_wg_row"] != 0) == (r["_wg_id"] in repeated) for r in named)
    cols = ("doc_id", "text", "_wg_n_removed", "_wg_words_removed", "_wg_removed")
    few = table(substring_dedup.remove_repeats(odd), *cols)
    monkeypatch.setattr(substring_dedup, "REPEATED_IDS", 1)
    assert all(r["_wg_row"] for r in substring_dedup._named(odd, "doc_id", "text").collect())
    assert table(substring_dedup.remove_repeats(odd), *cols) == few
