"""Quality classifier: ordinal (cumulative-link) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score:
P(grade <= j) = sigmoid(threshold_j - score). Selection uses the expected grade and the tail probability
of the best grade.

The model is fitted on the driver from a bounded sample of labelled rows, over features that a distributed
count has screened: what is collected are the screened features of whole texts. Training and scoring call the
same feature function; scoring reads whole texts of all documents in one narrow stage. Words are split, numbered
and counted a slice of texts at a time by Arrow and numpy; Python looks at a slice's distinct words alone.

Defined results: null and empty texts have no features and get the score 0; very long texts count in full, in
fitting too; documents without label are scored like the others; repeated rows get equal grades; of rows that
repeat a labelled id the smallest text is fitted; labels with a null or without document are ignored; with no
labelled row at all every document has the same grade; columns other than those named are not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.llm.common import shuffle_key

BITS = 18
#: Most labelled documents that are fitted on, and most hashed features that the screen leaves to the model.
SAMPLE, FEATURES = 8_000, 20_000
GRADES = 3  # 0 toxic, 1 poor, 2 good
EDGE = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$")
#: Bytes of texts that are split into words at once (a longer text goes alone).
SLICE = 4 << 20


class Features:
    """Hashed features of a text: its stripped lower-case words, the marks cut off them, and their case."""

    def __init__(self, bits: int = BITS):
        self.bits, self.memo = bits, {b"": (-1, -1, -1)}

    def _of(self, word: bytes) -> tuple[int, int, int]:
        """(word, marks, case) numbers; -1 for none."""
        found = self.memo.get(word)
        if found is None:
            core = EDGE.sub(b"", word)
            number = lambda x: xxhash.xxh64_intdigest(x) & ((1 << self.bits) - 1)
            found = number(b"w " + core.lower()), number(b"m " + word[len(word.rstrip(b"#*$%&|<>!?.,;:")) :]), number(b"upper") if len(core) > 1 and core.isupper() else -1
            if len(self.memo) < 200_000:
                self.memo[word] = found
        return found

    def table(self, texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of the distinct features of each text, those outside the mask ``keep`` left out.

        Values are 1 + log of the count, for marks and case shares of all words.
        """
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        doc = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
        coded = split.flatten().cast(pa.binary()).dictionary_encode()
        of = np.array([self._of(w) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 3)
        code = coded.indices.to_numpy()
        total = np.bincount(doc[(of[:, 1] >= 0)[code]], minlength=len(texts))
        if keep is not None:
            of = np.where((of >= 0) & keep[of], of, -1)

        def counts(columns: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys = [doc[have] << self.bits | of[code[have], c] for c in columns for have in [(of[:, c] >= 0)[code]]]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return key >> self.bits, key & ((1 << self.bits) - 1), n

        (d1, f1, n1), (d2, f2, n2) = counts((0,)), counts((1, 2))
        return np.concatenate([d1, d2]), np.concatenate([f1, f2]), np.concatenate([1 + np.log(n1), 8 * n2 / np.maximum(1, total[d2])])

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of one text."""
        return self.table(pa.array([text], pa.string()))[1:]


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(offset, texts) of at most ``SLICE`` bytes, or of one text."""
    sizes, lo, held = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE:
            yield lo, texts.slice(lo, i - lo)
            lo, held = i, 0
        held += int(n) + 1
    if lo < len(texts):
        yield lo, texts.slice(lo)


class OrdinalModel:
    """Shared weights and ordered thresholds, fitted by AdaGrad on the cumulative-link likelihood."""

    def __init__(self, bits: int = BITS, grades: int = GRADES):
        self.weights = np.zeros(1 << bits, np.float32)
        self.cuts = np.arange(grades - 1, dtype=np.float64) - (grades - 2) / 2

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, epochs: int = 20, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> OrdinalModel:
        if not len(rows):
            return self
        rng, w, g2 = np.random.default_rng(seed), np.zeros(len(self.weights)), np.full(len(self.weights), 1e-2)
        share = np.bincount(grade, minlength=len(self.cuts) + 1)
        weight = np.sqrt(len(grade) / np.maximum(1, share) / len(share))  # half way to grades that count alike
        cut2 = np.full(len(self.cuts), 1.0)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                (idx, val), y = rows[i], grade[i]
                z = 1 / (1 + np.exp(np.clip(w[idx] @ val - self.cuts, -30, 30)))  # P(grade <= j)
                full = np.concatenate([[0.0], z, [1.0]])
                p, slope = max(full[y + 1] - full[y], 1e-9), full * (1 - full)
                up = weight[y] * (slope[y + 1] - slope[y]) / p  # d loss / d score
                grad = up * val + decay * w[idx]
                g2[idx] += grad * grad
                w[idx] -= rate * grad / np.sqrt(g2[idx])
                step = np.zeros(len(self.cuts))
                if y < len(self.cuts):
                    step[y] -= weight[y] * slope[y + 1] / p
                if y:
                    step[y - 1] += weight[y] * slope[y] / p
                cut2 += step * step
                self.cuts = np.maximum.accumulate(self.cuts - rate * step / np.sqrt(cut2))
        self.weights = w.astype(np.float32)
        return self

    def grades(self, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j, of one text."""
        return self.tails(np.array([float(self.weights[idx] @ val)]))[0]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score (a row) and threshold j."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score[:, None], -30, 30)))


def screen(df: np.ndarray, above: np.ndarray, share: np.ndarray, n: int, least: int = 4, deviations: float = 4.0, most: int = FEATURES) -> np.ndarray:
    """Mask of the features whose documents' grades differ from all by over ``deviations`` at some threshold.

    ``df`` documents have a feature, ``above[j]`` of them a grade over j, as ``share[j]`` of all ``n`` have. Without
    the screen a few thousand ratings would fit the noise of as many rare words. Of more than ``most`` the most deviating stay.
    """
    far = np.zeros(len(df))
    for a, p in zip(above, share):
        spread = np.sqrt(np.maximum(df * p * (1 - p) * (1 - df / max(1, n)), 1e-9))
        far = np.maximum(far, np.where((df >= least) & (spread > 1e-3), np.abs(a - df * p) / spread, 0))
    keep = far >= deviations
    if keep.sum() > most:
        keep[np.argsort(-far, kind="stable")[most:]] = False
    return keep


def screened(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, bits: int = BITS, grades: int = GRADES) -> np.ndarray:
    """``screen`` over rows held in memory."""
    df, above = np.zeros(1 << bits), np.zeros((grades - 1, 1 << bits))
    for (idx, _), g in zip(rows, grade):
        df[idx] += 1
        above[:g, idx] += 1
    return screen(df, above, np.array([np.mean(grade > j) if len(grade) else 0.0 for j in range(grades - 1)]), len(rows))


def grade_of(quality: int, toxic: int) -> int:
    return 0 if toxic else 1 + int(quality > 0)


def _sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text: str) -> DataFrame:
    """(i, grade, text) of at most ``sample`` labelled documents, the first by the hash of their id."""
    picked = labels.select(F.col(id_col).cast("long").alias("i"), F.col("quality").alias("q"), F.col("toxic").alias("t")).dropna()
    picked = picked.groupBy("i").agg(F.max("q").alias("q"), F.max("t").alias("t")).orderBy(shuffle_key(F.col("i"))).limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("x"))
    grade = F.when(F.col("t") != 0, 0).otherwise(1 + (F.col("q") > 0).cast("int"))  # ``grade_of``
    return durable(texts.join(F.broadcast(picked.select("i", grade.alias("grade"))), "i").groupBy("i", "grade").agg(F.min("x").alias("text")))  # bounded by the sample


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text") -> OrdinalModel:
    """A model of at most ``sample`` labelled documents; their features are screened before they are collected."""
    rows = _sample(docs, labels, sample, id_col, text)
    held = dict(rows.groupBy("grade").agg(F.count("*")).collect())  # a row per grade
    n = sum(held.values())
    share = np.array([sum(c for g, c in held.items() if g > j) / max(1, n) for j in range(GRADES - 1)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, df, above = Features(), np.zeros(1 << BITS, np.int64), np.zeros((GRADES - 1, 1 << BITS), np.int64)
        for b in batches:
            grade = b.column(0).to_numpy()
            for lo, part in _slices(b.column(1)):
                doc, idx, _ = make.table(part)
                pairs = np.unique(doc << BITS | idx)  # a word and a mark may share a number
                doc, idx = pairs >> BITS, pairs & ((1 << BITS) - 1)
                np.add.at(df, idx, 1)
                for j in range(GRADES - 1):
                    np.add.at(above[j], idx[grade[lo + doc] > j], 1)
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(df[have]), *(pa.array(a[have]) for a in above)], names=["f", "n", *(f"a{j}" for j in range(GRADES - 1))])

    tails = [f"a{j}" for j in range(GRADES - 1)]
    counted = rows.select("grade", "text").mapInArrow(count, "f long, n long, " + ", ".join(f"{a} long" for a in tails))
    got = counted.groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n", *tails))).toPandas()  # at most 2^BITS rows
    df, above = np.zeros(1 << BITS), np.zeros((GRADES - 1, 1 << BITS))
    df[got["f"]], above[:, got["f"]] = got["n"], got[tails].to_numpy().T
    keep = screen(df, above, share, n)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            for lo, part in _slices(b.column(2)):
                doc, idx, val = make.table(part, keep)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(len(part) + 1))
                pack = lambda x, t: pa.array([x[order[s:e]].astype(t).tobytes() for s, e in zip(cut, cut[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), b.column(1).slice(lo, len(part)), pack(idx, np.int32), pack(val, np.float64)], names=["i", "grade", "idx", "val"])

    found = rows.mapInArrow(features, "i long, grade int, idx binary, val binary").toPandas().sort_values("i")  # screened features of the sample
    data = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float64)) for a, v in zip(found["idx"], found["val"])]
    return OrdinalModel().fit(data, found["grade"].to_numpy(np.int64))


def grade_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_poor_or_better, p_good, kept): a row per row of ``docs``.

    Kept are documents whose best grade is likelier than not.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, fitted = Features(), model.value
        keep, weights = fitted.weights != 0, fitted.weights.astype(np.float64)
        for b in batches:
            for lo, part in _slices(b.column(1)):
                doc, idx, val = make.table(part, keep)
                total = np.bincount(doc, val * weights[idx], len(part))
                tails = fitted.tails(total)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), *(pa.array(x) for x in (tails.sum(1), tails[:, 0], tails[:, 1], tails[:, 1] >= 0.5))], names=["doc_id", "e", "p1", "p2", "k"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(score, "doc_id long, expected_grade double, p_poor_or_better double, p_good double, kept boolean")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return grade_documents(read("documents").select("doc_id", "text"), read("labels").select("doc_id", "quality", "toxic"))
