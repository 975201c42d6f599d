"""Substring dedup by sliding sentence spans.

Sentences end at ``.``, ``!`` or ``?`` before white space, or at a line end. A sentence of more than
``LONG_SENTENCE`` words is cut into units of a few words, at words that their own hash picks, so that a copied
passage is cut alike wherever it begins or ends; any other sentence is one unit. A span starts at every unit
and takes the fewest units after it that make ``min_sentences`` and ``min_words`` (a unit of ``long_words`` is
a span alone). Spans of equal words (A-Z folded, white space normalised) are joined globally by a 128-bit hash;
all but the first, in the order of document id and position, are repeated, and every unit that a repeated
span covers is removed.

Spans are made once and stored without text. The first document of a hash is a map-side combined minimum over
one span per hash and document; only hashes that two documents share meet the spans again, in a join whose hot
hashes Spark can split. Copies within a document are known where it is read.

What escapes: a copied run of fewer than ``min_words`` words between its first and last cut.

Defined results: null and empty texts have no sentences; null ids rank last; rows that repeat an id and text
are one document; a span repeated within a document loses its later copies; extra columns pass through, those
that this operator's own columns (``_wg_...``) would clash with excepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.durable import Scratch, durable
from weftgraph.llm.common import bounded_broadcast, shielded, text_of, values_of

#: A sentence with the white space after it, and a word with the white space after it.
SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?](?![ \t\n\r\f\v])[^.!?\n]*)*(?:[.!?]|\n|\Z)[ \t\n\r\f\v]*")
TOKEN = re.compile(rb"[^ \t\n\r\f\v]+[ \t\n\r\f\v]*")
#: Of a passage of 50 words that is cut anywhere, units of 3 to 9 words on average leave well over 28 inside.
MIN_SENTENCES, MIN_WORDS, LONG_WORDS = 2, 28, 50
#: Words of a sentence beyond which it is cut, least words of a unit, and one in how many words ends one.
LONG_SENTENCE, LEAST_UNIT, CUT_EVERY = 16, 3, 6
LAST_ID = 2**63 - 1
ROWS = 50_000
#: Repeated ids that are broadcast.
REPEATED_IDS = 20_000


def sentences(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each sentence of UTF-8 text; together they are the whole text."""
    return [m.span() for m in SENTENCE.finditer(data) if m.end() > m.start()]


def units(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, number of words, words joined by blanks) of each unit of UTF-8 text; together they are the whole text."""
    out, low = [], data.lower()  # bytes: ASCII case and ASCII white space alone
    for start, end in sentences(data):
        words = low[start:end].split()
        if len(words) > LONG_SENTENCE:
            plain, ends, lo, at = low.startswith(b" ".join(words), start), None, 0, start  # plain: single blanks between words
            for k in [k for k, w in enumerate(words) if not crc32(w) % CUT_EVERY]:
                if k + 1 - lo >= LEAST_UNIT and k + 1 < len(words):
                    part = b" ".join(words[lo : k + 1])
                    if not plain:
                        ends = ends or [m.end() for m in TOKEN.finditer(data, start, end)]
                    upto = at + len(part) + 1 if plain else ends[k]
                    out.append((at, upto, k + 1 - lo, part))
                    lo, at = k + 1, upto
            words, start = words[lo:], at
        out.append((start, end, len(words), b" ".join(words)))
    return out


def spans(data: bytes, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(first unit, number of units, start, end, 16-byte digest) of each span; starts and ends both ascend."""
    parts = units(data)
    size, words = [p[2] for p in parts], [p[3] for p in parts]
    out, end, n = [], 0, 0
    for i in range(len(parts)):
        if end < i:
            end, n = i, 0
        while end < len(parts) and not ((end - i >= min_sentences and n >= min_words) or (end - i and n >= long_words)):
            n += size[end]
            end += 1
        if n < min_words or (end - i < min_sentences and n < long_words):
            break
        # The fewest units: the window of the unit before may reach further than this one needs.
        j, m = end, n
        while j - i > 1 and (((j - 1 - i) >= min_sentences and m - size[j - 1] >= min_words) or m - size[j - 1] >= long_words):
            j, m = j - 1, m - size[j - 1]
        out.append((i, j - i, parts[i][0], parts[j - 1][1], xxhash.xxh3_128_digest(b" ".join(w for w in words[i:j] if w))))
        n -= size[i]
    return out


def _named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with _wg_id and _wg_row, which tells texts of one id apart: a hash of the text where ids repeat, else 0.

    Every span carries it through two shuffles, where a hash cannot be compressed. Should more than
    ``REPEATED_IDS`` ids repeat, all rows have the hash.
    """
    own, row = docs.withColumn("_wg_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))), F.xxhash64(text_of(text))
    repeated = own.groupBy("_wg_id").count().filter("count > 1").select(F.col("_wg_id").alias("_wg_twice")).limit(REPEATED_IDS + 1)
    ids = [r[0] for r in repeated.collect()]
    if not ids:
        return own.withColumn("_wg_row", F.lit(0).cast("long"))
    if len(ids) > REPEATED_IDS:
        return own.withColumn("_wg_row", row)
    few = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in ids], "_wg_twice long"))
    return own.join(few, F.col("_wg_id") == F.col("_wg_twice"), "left").withColumn("_wg_row", F.when(F.col("_wg_twice").isNotNull(), row).otherwise(F.lit(0).cast("long"))).drop("_wg_twice")


def _span_rows(docs: DataFrame, text: str) -> DataFrame:
    """(_wg_id, _wg_row, _wg_bytes, _wg_h1, _wg_h2, _wg_again) per span; the last tells a copy within its document.

    ``_wg_bytes`` holds start and end in the UTF-8 text, 32 bits each.
    """
    names = ["_wg_id", "_wg_row", "_wg_bytes", "_wg_h1", "_wg_h2", "_wg_again"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, places, digests, again = held = [], [], [], [], []

        def batch() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            out = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, rows, places)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(again, pa.bool_())], names=names)
            for x in held:
                x.clear()
            return out

        for b in batches:
            for i, row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), values_of(b.column(2).cast(pa.binary()))):
                own: set[bytes] = set()
                for _, _, start, end, digest in spans(t):
                    ids.append(i), rows.append(row), places.append(start << 32 | end), digests.append(digest), again.append(digest in own)
                    own.add(digest)
                    if len(ids) == ROWS:
                        yield batch()
        if ids:
            yield batch()

    slim = docs.select("_wg_id", "_wg_row", text_of(text).alias("_wg_text"))
    return slim.mapInArrow(make, "_wg_id long, _wg_row long, _wg_bytes long, _wg_h1 long, _wg_h2 long, _wg_again boolean")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_wg_id, _wg_row, _wg_spans): the non-first spans of each document of ``_named``, as ``_wg_bytes`` in order."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.store(_span_rows(docs, text))
    once = rows.filter(~F.col("_wg_again")).drop("_wg_again")
    doc = F.struct("_wg_id", "_wg_row")
    firsts = once.groupBy("_wg_h1", "_wg_h2").agg(F.min(doc).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = durable(firsts.select("_wg_h1", "_wg_h2", "first"))
    place = ["_wg_id", "_wg_row", "_wg_bytes"]
    hits = once.join(bounded_broadcast(firsts), ["_wg_h1", "_wg_h2"]).filter(doc != F.col("first")).select(*place).union(rows.filter("_wg_again").select(*place))
    found = durable(hits.groupBy("_wg_id", "_wg_row").agg(F.sort_array(F.collect_set("_wg_bytes")).alias("_wg_spans")))
    scratch.drop()
    return found


def _merged(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Unions of [start, end) ranges whose starts and ends ascend."""
    out: list[list[int]] = []
    for start, end in pairs:
        if out and out[-1][1] >= start:
            out[-1][1] = end
        else:
            out.append([start, end])
    return out


def _cut(data: bytes, marks: list[int]) -> tuple[bytes, int, int, list[list[int]]]:
    """(what is left, units and words that go, ranges that go in code points) of UTF-8 text."""
    gone = _merged([(m >> 32, m & 0xFFFFFFFF) for m in marks])
    starts = np.array([u[0] for u in units(data)], np.int64)  # spans begin and end where units do
    number = sum(int(np.searchsorted(starts, e) - np.searchsorted(starts, s)) for s, e in gone)
    kept, chars, at, points = [], [], 0, 0
    for s, e in gone:
        kept.append(data[at:s])
        points += len(kept[-1].decode("utf-8", "replace"))
        chars.append([points, points := points + len(data[s:e].decode("utf-8", "replace"))])
        at = e
    return b"".join([*kept, data[at:]]), number, sum(len(data[s:e].split()) for s, e in gone), chars


@shielded
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated units, and _wg_n_removed (units), _wg_words_removed, _wg_removed.

    ``_wg_removed`` lists the removed ranges of the whole text as [start, end) code points.
    """
    keyed = _named(docs, id_col, text)
    found = repeated_spans(keyed, text)
    joined = keyed.join(found, ["_wg_id", "_wg_row"], "left").select(*docs.columns, "_wg_spans")
    at, n = joined.columns.index(text), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, spans_of = b.column(at).cast(pa.binary()), b.column(n)
            have = np.flatnonzero(spans_of.is_valid().to_numpy(zero_copy_only=False))
            done = {int(k): _cut(column[k].as_py() or b"", spans_of[k].as_py()) for k in have}
            none = (None, 0, 0, [])
            gone, words, ranges = ([done.get(k, none)[c] for k in range(b.num_rows)] for c in (1, 2, 3))
            own = list(b.columns[:n])
            if done:
                own[at] = pa.array([done[k][0] if k in done else x for k, x in enumerate(values_of(column))], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(gone, pa.int64()), pa.array(words, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int32())))], names=[str(i) for i in range(n + 3)])

    schema = docs.withColumn(text, F.col(text).cast("string")).schema
    for name in ("_wg_n_removed", "_wg_words_removed"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("_wg_removed", T.ArrayType(T.ArrayType(T.IntegerType())))
    return joined.withColumn(text, F.col(text).cast("string")).mapInArrow(cut, schema)


def op9_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", F.col("_wg_n_removed").alias("n_removed"), F.col("_wg_words_removed").alias("n_words_removed"), F.col("_wg_removed").alias("removed"), F.sha2(text_of("text"), 256).alias("kept_sha256")
    )
