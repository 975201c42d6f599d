"""URL filters by a ratio of two character language models.

Two variable-order Markov models (interpolated Witten-Bell smoothing down to a uniform one) are trained on the
accepted and the rejected URLs, all that the explicit rules label. A URL's score is the difference of its
log-likelihoods per character; a threshold calibrated on held-out URLs makes it a verdict. Rules come first.

Nothing is sampled and no task or driver holds a model: counts of character sequences are aggregates of all distinct training
URLs, four in five by hash order; URLs are scored in buckets of some ``BUCKET`` bytes, and each is joined with the
counts of the sequences that occur in it. The threshold is the best of all cuts between the scores of the other fifth.

Defined results: a null URL or one without ``://`` has an empty host and path and meets no rule; the
models read the whole URL, query and fragment with it, and a null one as an empty string; without any labelled
URL both models are uniform and everything is allowed; repeated rows get equal verdicts; extra columns pass through.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.functions.ordering import dense_ids
from weftgraph.llm.common import LOWER, UPPER, running_total, shielded, text_of

#: (verdict, host and path prefix): the longest that fits wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 5
ALPHABET = 256
#: Bytes of distinct URLs that are scored together, and bytes that are unrolled at a time.
BUCKET, SLICE = 1 << 18, 1 << 16
#: Per byte sequence and class: how often it occurs, how often anything follows it, and how many different bytes do.
COUNTS = ("n_allow", "n_block", "t_allow", "t_block", "d_allow", "d_block")


class CharModel:
    """The model of a list of URLs, in memory: P(byte | up to ``order`` bytes before it), Witten-Bell: each context backs off to its suffix."""

    def __init__(self, urls: list[bytes], order: int = ORDER):
        self.order, self.memo = order, {}
        counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for url in urls:
            s = self.framed(url)
            for i in range(1, len(s)):
                for k in range(min(i, order) + 1):
                    counts[s[i - k : i]][s[i]] += 1
        self.counts = {c: (dict(n), sum(n.values())) for c, n in counts.items()}

    @staticmethod
    def framed(url: bytes) -> bytes:
        return b"\x02" + url + b"\x03"

    def prob(self, context: bytes, byte: int) -> float:
        found = self.counts.get(context)
        lower = self.prob(context[1:], byte) if context else 1 / ALPHABET
        if not found:
            return lower
        seen, total = found
        return (seen.get(byte, 0) + len(seen) * lower) / (total + len(seen))

    def loglik(self, url: bytes) -> float:
        """Mean log-likelihood of the URL's bytes and its end mark."""
        s, memo, total = self.framed(url), self.memo, 0.0
        for i in range(1, len(s)):
            gram = s[max(0, i - self.order) : i + 1]
            p = memo.get(gram)
            if p is None:
                p = math.log(self.prob(gram[:-1], gram[-1]))
                if len(memo) < 2_000_000:
                    memo[gram] = p
            total += p
        return total / (len(s) - 1)


class RatioFilter:
    """Two such models in memory: accepted against rejected model, with a threshold from URLs that neither was trained on."""

    def __init__(self, accepted: list[bytes], rejected: list[bytes], order: int = ORDER):
        fit = lambda x: [u for i, u in enumerate(x) if i % 5] or x
        held = lambda x: [u for i, u in enumerate(x) if not i % 5]
        self.good, self.bad = CharModel(fit(accepted), order), CharModel(fit(rejected), order)
        self.threshold = 0.0
        if accepted and rejected:
            a, r = (np.array([self.score(u) for u in held(x)]) for x in (accepted, rejected))
            cuts = np.unique(np.concatenate([a, r, [0.0]]))
            cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
            wrong = [np.mean(a < c) + np.mean(r >= c) for c in cuts]
            best = np.flatnonzero(np.isclose(wrong, min(wrong)))
            self.threshold = float(cuts[best[np.argmin(np.abs(cuts[best]))]])  # of equal cuts the one nearest to no preference

    def score(self, url: bytes) -> float:
        return self.good.loglik(url) - self.bad.loglik(url)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    full = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, full, 1), UPPER, LOWER), F.regexp_extract(u, full, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = pattern.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _slices(urls: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of URLs of about ``SLICE`` bytes."""
    own, size = [], 0
    for u in urls:
        own.append(u)
        size += len(u)
        if size >= SLICE:
            yield own
            own, size = [], 0
    if own:
        yield own


def _sequences(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, URL of each place): ``keys[k]`` names the k bytes that end at each byte of the framed URLs, -1 if it has fewer.

    A key holds the bytes and, in its lowest byte, their number. Places are those of all bytes but the first of each URL.
    """
    framed = [CharModel.framed(u) for u in urls]
    sizes = np.array([len(x) for x in framed])
    s, at = np.frombuffer(b"".join(framed), np.uint8).astype(np.int64), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, value = np.full((ORDER + 2, len(s)), -1, np.int64), np.zeros(len(s), np.int64)
    keys[0] = 0
    for k in range(1, ORDER + 2):
        own = at >= k - 1
        value[own] |= s[np.flatnonzero(own) - (k - 1)] << 8 * (k - 1)
        keys[k, own] = value[own] << 8 | k
    return keys, np.flatnonzero(at), np.repeat(np.arange(len(urls)), sizes)[at > 0]


def _counts(fit: DataFrame) -> DataFrame:
    """(key, *COUNTS) of every sequence that occurs in the training URLs ``fit`` (u, v)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdicts = np.array(b.column(1).to_pylist())
            urls = b.column(0).to_pylist()
            for what in ("allow", "block"):
                for own in _slices([urls[i] for i in np.flatnonzero(verdicts == what)]):
                    keys, place, _ = _sequences(own)
                    found = keys[1:, place]
                    key, n = np.unique(found[found >= 0], return_counts=True)
                    none = np.zeros(len(key), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(n if what == w else none) for w in ("allow", "block"))], names=["key", "n_allow", "n_block"])

    grams = durable(fit.select("u", "v").mapInArrow(make, "key long, n_allow long, n_block long").groupBy("key").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")))
    before = F.shiftleft(F.shiftright("key", 16), 8) + F.col("key").bitwiseAND(255) - 1  # without the last byte
    after = [F.sum(f"n_{w}").alias(f"t_{w}") for w in ("allow", "block")] + [F.count_if(F.col(f"n_{w}") > 0).alias(f"d_{w}") for w in ("allow", "block")]
    contexts = grams.groupBy(F.when(F.col("key").bitwiseAND(255) > 1, before).otherwise(0).alias("key")).agg(*after)
    every = grams.unionByName(contexts, allowMissingColumns=True)
    return durable(every.groupBy("key").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)))


def _scored(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(u, v, held, s): the score of each URL of ``urls`` (u, v, held, b), bucket by bucket."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, every = np.array(b.column(1).to_pylist()), b.column(0).to_pylist()
            for k in np.unique(buckets):
                for own in _slices([every[i] for i in np.flatnonzero(buckets == k)]):
                    keys = np.unique(_sequences(own)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int64)), pa.array(keys)], names=["b", "key"])

    def score(mine: pa.Table, have: pa.Table) -> pa.Table:
        known = have.column("key").to_numpy()
        order = np.argsort(known)
        known = known[order]
        stats = {c: np.append(have.column(c).to_numpy()[order], 0).astype(float) for c in COUNTS}  # the last: not there
        scores = []
        for own in _slices(mine.column("u").to_pylist()):
            keys, place, of = _sequences(own)
            at = np.searchsorted(known, keys)
            at[at < len(known)] = np.where(known[at[at < len(known)]] == keys[at < len(known)], at[at < len(known)], len(known))
            logs = []
            for w in ("allow", "block"):
                p = np.full(len(place), 1 / ALPHABET)
                for k in range(ORDER + 1):  # from no context to the whole one
                    context, gram = at[k, place - 1], at[k + 1, place]
                    total, kinds = stats[f"t_{w}"][context], stats[f"d_{w}"][context]
                    p = np.where(total > 0, (stats[f"n_{w}"][gram] + kinds * p) / np.maximum(total + kinds, 1), p)
                logs.append(np.bincount(of, np.log(p), len(own)) / np.bincount(of, minlength=len(own)))  # in the order of the bytes
            scores.append(logs[0] - logs[1])
        return pa.table([mine.column("u"), mine.column("v"), mine.column("held"), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["u", "v", "held", "s"])

    asked = urls.select("u", "b").mapInArrow(keys_of, "b long, key long").distinct()
    parts = asked.join(counts, "key").select("b", "key", *COUNTS).groupBy("b")
    return durable(urls.groupBy("b").cogroup(parts).applyInArrow(score, "u binary, v string, held boolean, s double"))


def _threshold(held: DataFrame) -> float:
    """The cut between neighbouring scores of ``held`` (v, s) that misjudges the least share of both classes; of equal ones the nearest to 0."""
    points = held.groupBy("s").agg(F.count_if(F.col("v") == "allow").alias("a"), F.count_if(F.col("v") == "block").alias("r"))
    n, m, low, high = points.agg(F.sum("a"), F.sum("r"), F.min("s"), F.max("s")).first()
    if not n or not m:
        return 0.0
    zero = held.sparkSession.createDataFrame([(0.0, 0, 0)], "s double, a long, r long")
    points = points.union(zero).groupBy("s").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    low, high = min(low, 0.0), max(high, 0.0)
    if low == high:
        return low
    ranged = points.withColumn("range", F.floor((F.col("s") - low) / (high - low) * 4095).cast("int"))
    # Misjudged shares of a cut after this score: accepted ones below, rejected ones not below.
    sums = running_total(ranged, [], "range", ["s"], F.col("a") * F.lit(m) - F.col("r") * F.lit(n), "sum")
    wrong = durable(sums.select("s", (1 + F.col("sum") / F.lit(float(n) * float(m))).alias("wrong")))
    cuts = wrong.filter(F.col("s") < high)
    least = cuts.agg(F.min("wrong")).first()[0]
    good = cuts.filter(F.col("wrong") <= least + 1e-8 + 1e-5 * abs(least))
    near = good.agg(F.max(F.when(F.col("s") < 0, F.col("s"))), F.min(F.when(F.col("s") >= 0, F.col("s")))).first()
    found = [(x + wrong.filter(F.col("s") > x).agg(F.min("s")).first()[0]) / 2 for x in near if x is not None]
    return min(found, key=abs)


def train(urls: DataFrame) -> tuple[DataFrame, float]:
    """(scored URLs, threshold) of distinct ``urls`` (u, v): all labelled ones train the models or calibrate the threshold."""
    size = urls.agg(F.coalesce(F.sum(F.length("u")), F.lit(0))).first()[0]
    labelled = urls.filter("v IS NOT NULL").withColumn("h", F.xxhash64("u"))
    ranked = dense_ids(labelled.withColumn("range", F.shiftright("h", 52)), ["range"], ["h", "u"], "i", within=["v"]).withColumn("held", F.col("i") % 5 == 0)
    lone = F.lit(False)
    counts = {r["v"]: r["count"] for r in labelled.groupBy("v").count().collect()}
    for what, n in counts.items():
        lone = lone | (F.col("v") == what) & F.lit(n == 1)  # the one URL of a class both trains and calibrates
    every = ranked.select("u", "v", "held", lone.alias("lone")).union(urls.filter("v IS NULL").select("u", "v", F.lit(False), F.lit(False)))
    every = durable(every.withColumn("b", F.pmod(F.xxhash64("u"), F.lit(max(1, -(-size // BUCKET))))))
    scored = _scored(every.drop("lone"), _counts(every.filter("v IS NOT NULL AND (NOT held OR lone)")))
    return scored, _threshold(scored.filter("held"))


@shielded
def judge_urls(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with _wg_host, _wg_path, _wg_rule, _wg_score and _wg_verdict."""

    def ruled(df: DataFrame, url: str) -> DataFrame:
        host, path = url_parts(F.col(url))
        rule, verdict = rule_of(F.col("_wg_host"), F.col("_wg_path"), rules)
        return df.withColumns({"_wg_host": host, "_wg_path": path}).withColumns({"_wg_rule": rule, "_wg_verdict": verdict})

    distinct = ruled(pages.select(text_of(url).alias("_wg_url")).distinct(), "_wg_url")
    scored, threshold = train(durable(distinct.select(F.col("_wg_url").cast("binary").alias("u"), F.col("_wg_verdict").alias("v"))))
    scores = scored.select(F.col("u").alias("_wg_key"), F.col("s").alias("_wg_score"))
    # A URL of many pages: nothing but a projection follows the join, so it can be split.
    joined = ruled(pages.withColumn("_wg_key", text_of(url).cast("binary")).join(scores, "_wg_key", "left").drop("_wg_key"), url)
    own = F.when(F.col("_wg_score") >= threshold, "allow").otherwise("block")
    return joined.withColumn("_wg_verdict", F.coalesce("_wg_verdict", own)).select(*pages.columns, "_wg_host", "_wg_path", "_wg_rule", "_wg_score", "_wg_verdict")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    names = ("host", "path", "rule", "verdict", "score")
    return judge_urls(pages).select("page_id", *(F.col(f"_wg_{x}").alias(x) for x in names))
