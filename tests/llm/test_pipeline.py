"""The pipeline stage by stage against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.oracle import connect
from weftgraph.llm.packing import CAPACITY
from weftgraph.llm.queries import ORACLE_SQL


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_quality(stages, sf_dir):
    kept = {r[0] for r in connect(sf_dir).execute(f"SELECT doc_id FROM ({ORACLE_SQL['op3_quality_rules']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept


def test_lines(stages):
    want = {i: t for i, _, _, t in brute.line_dedup([(r["doc_id"], r["text"]) for r in stages[1].collect()])}
    assert {r["doc_id"]: r["text"] for r in stages[2].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near(stages):
    d = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    sets = [brute.shingles(t, 5) for _, t in d]
    comp = brute.groups(len(d), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted({d[c][0] for c in comp})


def test_mix(stages):
    rows = [(r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in stages[3].collect()]
    want = Counter({i: c for i, _, _, c in brute.mixing(rows) if c})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want


def test_pack(stages):
    want = Counter()
    for r in stages[4].collect():
        want[r["doc_id"]] += len(brute.words(r["text"]))
    have, used, members = Counter(), Counter(), {}
    for r in stages[5].collect():
        have[r["doc_id"]] += r["size"]
        if r["bin"] is None:
            assert r["size"] == 0
            continue
        used[r["bin"]] += r["size"]
        members.setdefault(r["bin"], []).append((r["source"], r["cluster"]))
    assert have == want and max(used.values()) <= CAPACITY
    assert all(len({s for s, _ in m}) == len({c for _, c in m}) == len(m) for m in members.values())


def test_run(spark, sf_dir, stages):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[-1])


def test_odd_tables(spark, odd, none, sf_dir, tmp_path):
    """Null ids, empty texts, repeated rows, extra columns that clash with internal names; and no row at all."""
    clash = odd.withColumns({"_wg_id": F.lit("x"), "_wg_size": F.lit(1), "_wg_kept": F.lit("y"), "_wg_row": F.lit(None).cast("string"), "_wg_text": F.lit(2)})
    for start, empty in ((clash, False), (clash.limit(0), True)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == start.dtypes, name
                out.write.parquet(str(tmp_path / f"{empty}{name}"))
                docs = spark.read.parquet(str(tmp_path / f"{empty}{name}"))
                assert {r["_wg_id"] for r in docs.collect()} <= {"x"}
        assert (out.count() == 0) == empty
