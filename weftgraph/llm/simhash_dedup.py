"""SimHash near-dedup by tiled exact comparison.

Fingerprints of distinct texts are cut into tiles by population count. Two tiles are compared
only if their counts come within the radius - a pair of words that many bits apart differs by no
more in its counts - and within a pair of tiles the same holds for blocks of 256 words and the counts of
their four 16-bit quarters. A comparison is a numpy exclusive-or and bit count. What leaves a pair of
tiles is a spanning forest of its links, never all pairs of a group.

With a similarity in place of a radius, links are exact: fingerprints of sets (repeated shingles count once)
give candidates, at the distance to expect of that similarity and three deviations more over all words
together, and only pairs whose sets have that Jaccard similarity link. Tiles and blocks then go by the size
of the sets, which cannot differ by more than the similarity. Only members of candidate groups are shingled again.

Tiles hold about ``tile_factor * sqrt(n)`` fingerprints, so both the number of tiles and their size grow
as the square root of the corpus; the comparisons themselves are quadratic, as the method is.

Defined results: null and empty texts have fingerprint 0 and link like any other; copies share a
fingerprint (with a similarity: texts of equal shingle sets are one node, empty ones among them); a component's id is its smallest non-null document id (null if it has none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions.durable import durable, small_batches
from weftgraph.llm.common import bounded_broadcast, shielded, text_of, values_of
from weftgraph.llm.components import components

BLOCK = 256
STEP = 8192
SEED = 42
EPS = 1e-6  # of a comparison of set sizes, which are whole numbers
#: Bits wider than expected at the similarity itself, in standard deviations, that candidates may lie apart.
MARGIN = 3.0
#: Steps of set sizes in one ratio of ``similarity``.
SIZE_STEPS = 8
#: Shingle hashes in a chunk of a candidate group: at least these, or this often the root of the group's number.
CHUNK, CHUNK_FACTOR = 1 << 20, 1 << 10


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in order; a text shorter than a shingle is one, an empty one has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space alone
    if not tokens:
        return np.zeros(0, np.uint64)
    ends, at = [], -1
    for w in tokens:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(tokens) - shingle + 1)
    view, digest = memoryview(b" ".join(tokens)), xxhash.xxh64_intdigest
    last = min(shingle, len(tokens)) - 1
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts, ends[last : last + n])), np.uint64, n)


def majority(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` 64-bit fingerprints: bits set in over half of the hashes.

    The first is over the hashes themselves; the others mix each hash with one odd constant more.
    """
    n, ones = len(hashes), np.zeros((words, 64), np.int64)
    for lo in range(0, n, STEP):
        h = hashes[lo : lo + STEP]
        for k in range(words):
            ones[k] += np.unpackbits((_mixed(h, k) if k else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, axis=1, bitorder="little")
    return [int.from_bytes(x.tobytes(), "little") for x in bits]


def fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """``words`` 64-bit fingerprints of a text's shingles, each as often as it occurs."""
    return majority(shingle_hashes(text, shingle), words)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A bijective mix of 64-bit values (a SplitMix64 step), another for each k."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str, text: str, shingle: int, words: int, sets: bool = False) -> DataFrame:
    """(_wg_id, _wg_text, _wg_words ARRAY<BIGINT>, _wg_size, _wg_set): one row per row of ``docs``.

    ``_wg_text`` is a hash of the text. With ``sets``, the words are over distinct shingles, ``_wg_size``
    is their number and ``_wg_set`` a hash of all of them; without, both are 0.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, marks = [], [], []
            for x in values_of(b.column(2)):
                h = shingle_hashes(x, shingle)
                h = np.unique(h) if sets else h
                fps.append(majority(h, words))
                sizes.append(len(h) if sets else 0)
                marks.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) if sets else 0)
            flat = pa.array(np.array(fps, np.uint64).reshape(-1, words).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, words), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(sizes, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["_wg_id", "_wg_text", "_wg_words", "_wg_size", "_wg_set"])

    slim = docs.select(F.col(id_col).cast("long").alias("_wg_id"), F.xxhash64(text_of(text)).alias("_wg_text"), F.col(text).cast("string").alias("_wg_body"))
    return slim.mapInArrow(make, "_wg_id long, _wg_text long, _wg_words array<long>, _wg_size long, _wg_set long")


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, word, more words) in the order of the first word's quarters; least and most count of each block."""
    q = _quarters(np.ascontiguousarray(x[:, 1]))
    order = np.lexsort(q.T[::-1])
    x, q = x[order], q[order]
    at = np.arange(0, len(x), BLOCK)
    return x, np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def linked(a: np.ndarray, b: np.ndarray | None, radius: int, total: int) -> list[tuple[int, int]]:
    """A spanning forest (of keys) of the links among the rows of ``a`` (b None) or between a and b.

    Rows link if the first words differ in at most ``radius`` bits and all words in at most ``total``.
    """
    xa, lo_a, hi_a = _blocks(a)
    xb, lo_b, hi_b = (xa, lo_a, hi_a) if b is None else _blocks(b)
    shift = 0 if b is None else len(xa)
    rows = xa if b is None else np.concatenate([xa, xb])
    first_a, first_b = np.ascontiguousarray(xa[:, 1]), np.ascontiguousarray(xb[:, 1])
    label = np.arange(len(rows))
    for i in range(len(lo_a)):
        gap = np.maximum(0, np.maximum(lo_a[i] - hi_b, lo_b - hi_a[i])).sum(1)
        near = np.flatnonzero(gap <= radius)
        block = first_a[i * BLOCK : (i + 1) * BLOCK, None]
        for j in near[near >= i] if b is None else near:
            p, q = np.nonzero(np.bitwise_count(block ^ first_b[j * BLOCK : (j + 1) * BLOCK][None, :]) <= radius)
            p, q = p + i * BLOCK, q + j * BLOCK + shift
            new = label[p] != label[q]
            p, q = p[new], q[new]
            if rows.shape[1] > 2 and len(p):
                close = np.bitwise_count(rows[p, 1:] ^ rows[q, 1:]).sum(1, dtype=np.int64) <= total
                p, q = p[close], q[close]
            if len(p):
                _join(label, label[p], label[q])
    members = np.flatnonzero(label != np.arange(len(rows)))
    key = np.ascontiguousarray(rows[:, 0]).view(np.int64)
    return list(zip(key[members].tolist(), key[label[members]].tolist()))


def alike(a: np.ndarray, b: np.ndarray | None, total: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest (of keys) of the candidates among the rows (key, size, words) of ``a`` (b None) or between a and b.

    Candidates differ in at most ``total`` bits over all words, and their sizes allow for ``similarity``.
    """
    a = a[np.argsort(a[:, 1], kind="stable")]
    b = a if b is None else b[np.argsort(b[:, 1], kind="stable")]
    same = b is a
    shift = 0 if same else len(a)
    rows = a if same else np.concatenate([a, b])
    size_a, size_b = a[:, 1].astype(np.float64), b[:, 1].astype(np.float64)
    words_a, words_b = (np.ascontiguousarray(x[:, 2:].T) for x in (a, b))
    label = np.arange(len(rows))
    for lo in range(0, len(a), BLOCK):
        hi = min(lo + BLOCK, len(a))
        start, stop = np.searchsorted(size_b, size_a[lo] * similarity - EPS), np.searchsorted(size_b, size_a[hi - 1] / similarity + EPS, "right")
        for at in range(max(start, lo) if same else start, stop, BLOCK):
            end = min(at + BLOCK, stop)
            apart = np.bitwise_count(words_a[0, lo:hi, None] ^ words_b[0, None, at:end]).astype(np.uint16)
            for x, y in zip(words_a[1:], words_b[1:]):
                apart += np.bitwise_count(x[lo:hi, None] ^ y[None, at:end])
            p, q = np.nonzero(apart <= total)
            fit = np.minimum(size_a[p + lo], size_b[q + at]) >= similarity * np.maximum(size_a[p + lo], size_b[q + at]) - EPS
            p, q = p[fit] + lo, q[fit] + at + shift
            new = label[p] != label[q]
            if new.any():
                _join(label, label[p[new]], label[q[new]])
    members = np.flatnonzero(label != np.arange(len(rows)))
    key = np.ascontiguousarray(rows[:, 0]).view(np.int64)
    return list(zip(key[members].tolist(), key[label[members]].tolist()))


def confirmed(rows: list[np.ndarray], words: int, total: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest (of keys) of the links among rows (side, key, words, distinct shingle hashes in order).

    Rows link if their words differ in at most ``total`` bits and their hashes have a Jaccard similarity of
    at least ``similarity``. If there are two sides, only rows of different ones are compared.
    """
    rows = sorted(rows, key=len)
    head = np.array([x[: words + 2] for x in rows], np.int64).reshape(-1, words + 2)
    side, key, fps, sets = head[:, 0], head[:, 1], np.ascontiguousarray(head[:, 2:]).view(np.uint64), [x[words + 2 :] for x in rows]
    size = np.array([len(x) for x in sets], np.float64)
    two, label, found = len(np.unique(side)) > 1, np.arange(len(rows)), []
    for i in range(len(rows)):
        stop = np.searchsorted(size, size[i] / similarity + EPS, "right")
        near = np.bitwise_count(fps[i + 1 : stop] ^ fps[i]).sum(1, dtype=np.int64) <= total
        near &= label[i + 1 : stop] != label[i]
        if two:
            near &= side[i + 1 : stop] != side[i]
        left = np.flatnonzero(near) + i + 1
        while len(left):
            j, left = left[0], left[1:]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (size[i] + size[j] - both) - EPS:
                found.append((int(key[i]), int(key[j])))
                label[label == label[j]] = label[i]
                left = left[label[left] != label[i]]
    return found


def _join(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Merges the labels that the pairs (p, q) link; labels stay indices of a member of their own class."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    for x, y in np.unique(np.stack([p, q], 1), axis=0).tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for x in list(parent):
        to[x] = root(x)
    label[:] = to[label]


def _bands(counts: dict[int, int], per_tile: int) -> list[tuple[int, int, int]]:
    """(least, most population count, tiles) of bands that hold ``per_tile`` fingerprints a tile."""
    bands, lo, held = [], None, 0
    for ones in sorted(counts):
        lo, held = (ones if lo is None else lo), held + counts[ones]
        if held >= per_tile:
            bands.append((lo, ones, -(-held // per_tile)))
            lo, held = None, 0
    return [*bands, (lo, max(counts), 1)] if held else bands


def _edges(nodes: DataFrame, reach: int, tile_factor: int, forest) -> DataFrame:
    """(u, v): forests of the links between keys, from all pairs of tiles whose bands come within ``reach``.

    ``nodes`` are (_wg_key, _wg_band, _wg_tile_row); ``forest`` compares the rows of two tiles, or of one (and None).
    """
    spark = nodes.sparkSession
    ones = F.col("_wg_band")
    counts = {r["ones"]: r["n"] for r in nodes.groupBy(ones.alias("ones")).agg(F.count("*").alias("n")).collect()}  # bit counts (65) or steps of sizes (hundreds)
    per_tile = max(1, int(tile_factor * math.sqrt(sum(counts.values()))))
    bands = _bands(counts, per_tile)
    offset = [sum(b[2] for b in bands[:i]) for i in range(len(bands))]
    tile = F.lit(None).cast("long")
    for (lo, hi, n), at in zip(bands, offset):
        tile = F.when((ones >= lo) & (ones <= hi), at + F.pmod(F.xxhash64("_wg_key"), F.lit(n))).otherwise(tile)
    rows = F.flatten(F.collect_list("_wg_tile_row"))
    tiles = durable(nodes.groupBy(tile.alias("tile")).agg(rows.alias("rows"), F.max(F.size("_wg_tile_row")).alias("width")))
    near = [(offset[i], bands[i][2], offset[j], bands[j][2]) for i in range(len(bands)) for j in range(i, len(bands)) if bands[j][0] - bands[i][1] <= reach]
    pairs = spark.createDataFrame(near, "p long, n long, q long, m long").withColumn("a", F.explode(F.sequence("p", F.col("p") + F.col("n") - 1)))
    pairs = pairs.select("a", F.explode(F.sequence("q", F.col("q") + F.col("m") - 1)).alias("b")).filter("a <= b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, width = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                x, y = (batch.column(c)[k].values.to_numpy().view(np.uint64).reshape(-1, width) for c in (2, 3))
                found = forest(x, None if same else y)
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    work = pairs.join(tiles.select(F.col("tile").alias("a"), "width", F.col("rows").alias("x")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("rows").alias("y")), "b")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return work.repartition(tasks, "a", "b").select((F.col("a") == F.col("b")).alias("same"), "width", "x", "y").mapInArrow(compare, "u long, v long")


def _exact_edges(docs: DataFrame, text: str, shingle: int, nodes: DataFrame, groups: DataFrame, words: int, total: int, similarity: float) -> DataFrame:
    """(u, v): forests of the exact links within candidate groups (_wg_key, _wg_group).

    A large group is cut into chunks by hash, and each pair of its chunks is compared by a task of its own.
    """
    members = durable(nodes.join(groups, "_wg_key").select("_wg_key", "_wg_group", "_wg_text", "_wg_words", "_wg_size"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, shingle)).view(np.int64) for x in values_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_wg_text", "_wg_hashes"])

    bodies = docs.select(F.xxhash64(text_of(text)).alias("_wg_text"), text_of(text).alias("_wg_body")).join(bounded_broadcast(members.select("_wg_text").distinct()), "_wg_text", "left_semi")
    bodies = bodies.groupBy("_wg_text").agg(F.min("_wg_body").alias("_wg_body"))
    chunk = F.greatest(F.lit(CHUNK), CHUNK_FACTOR * F.sqrt("held"))
    held = members.groupBy("_wg_group").agg(F.sum("_wg_size").alias("held")).select("_wg_group", F.greatest(F.lit(1), F.ceil(F.col("held") / chunk)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64(F.lit("chunk"), "_wg_key"), F.col("chunks"))
    with small_batches(docs.sparkSession, 64):
        sets = bodies.mapInArrow(shingled, "_wg_text long, _wg_hashes array<long>")
        dealt = members.join(held, "_wg_group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        row = F.concat(F.array((F.col("own") > F.col("other")).cast("long"), F.col("_wg_key")), "_wg_words", "_wg_hashes")
        pairs = durable(dealt.join(sets, "_wg_text").groupBy("_wg_group", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list(row).alias("rows")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                lists = batch.column(0)[k].values
                found += confirmed([lists[i].values.to_numpy() for i in range(len(lists))], words, total, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    with small_batches(docs.sparkSession, 16):
        return durable(pairs.select("rows").mapInArrow(compare, "u long, v long"))


def similarity_radius(similarity: float, bits: int) -> int:
    """Differing bits to expect of two texts whose shingle sets have this Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def candidate_radius(similarity: float, bits: int) -> int:
    """Differing bits that all but about one in a thousand texts of this similarity stay within."""
    expected = bits * math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(expected + MARGIN * math.sqrt(expected * (1 - expected / bits)))


def _rooted(docs: DataFrame, id_col: str, text: str, shingle: int, words: int, similarity: float, radius: int | None, tile_factor: int) -> tuple[DataFrame, DataFrame]:
    """Rows (_wg_id, _wg_text, _wg_words, _wg_key) of ``docs``, and (_wg_key, _wg_root, _wg_component) of their keys."""
    rows = fingerprints(docs, id_col, text, shingle, words, radius is None)
    key = F.col("_wg_set") if radius is None else F.col("_wg_words")[0] if words == 1 else F.xxhash64("_wg_words")
    with small_batches(docs.sparkSession):
        rows = durable(rows.withColumn("_wg_key", key))
    least = [F.min(x).alias(x) for x in ("_wg_words", "_wg_text", "_wg_size")]
    nodes = durable(rows.groupBy("_wg_key").agg(F.min("_wg_id").alias("_wg_first"), *least))
    if nodes.isEmpty():
        return rows, nodes.select("_wg_key", F.col("_wg_key").alias("_wg_root"), F.col("_wg_first").alias("_wg_component"))
    if radius is None:
        total = candidate_radius(similarity, 64 * words)
        band = F.floor(F.log(F.greatest(F.lit(1), F.col("_wg_size"))) * (SIZE_STEPS / -math.log(similarity))) if similarity < 1 else F.col("_wg_size")
        rated = nodes.select("_wg_key", band.alias("_wg_band"), F.concat(F.array("_wg_key", "_wg_size"), "_wg_words").alias("_wg_tile_row"))
        # One step more than the ratio takes: logarithms are rounded.
        linked_to = components(_edges(rated, SIZE_STEPS + 1, tile_factor, lambda x, y: alike(x, y, total, similarity)))
        groups = durable(linked_to.select(F.col("u").alias("_wg_key"), F.col("root").alias("_wg_group")).union(linked_to.select("root", "root").distinct()))
        linked_to = components(_exact_edges(docs, text, shingle, nodes, groups, words, total, similarity))
    else:
        screen = radius if words == 1 else min(64, math.ceil(radius / words + 2.2 * math.sqrt(radius / words * (1 - radius / 64 / words))))
        counted = nodes.select("_wg_key", F.bit_count(F.col("_wg_words")[0]).alias("_wg_band"), F.concat(F.array("_wg_key"), "_wg_words").alias("_wg_tile_row"))
        linked_to = components(_edges(counted, screen, tile_factor, lambda x, y: linked(x, y, screen, radius)))
    # The root of each key's class, then the smallest id of the class.
    rooted = nodes.join(linked_to, nodes["_wg_key"] == linked_to["u"], "left").select("_wg_key", "_wg_first", F.coalesce("root", "_wg_key").alias("_wg_root"))
    rooted = durable(rooted)
    # Keys that are alone are their own class. The others' classes are a table of their own, so that the join has
    # nothing but exchanges below it and a class of many keys can be split.
    classes = rooted.groupBy("_wg_root").agg(F.min("_wg_first").alias("_wg_least"), F.count("*").alias("n")).filter("n > 1")
    classes = durable(classes.select("_wg_root", "_wg_least", F.lit(True).alias("_wg_many")))
    named = rooted.join(bounded_broadcast(classes), "_wg_root", "left")
    return rows, durable(named.select("_wg_key", "_wg_root", F.when(F.col("_wg_many"), F.col("_wg_least")).otherwise(F.col("_wg_first")).alias("_wg_component")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, words: int = 4, similarity: float = 0.8, radius: int | None = None, tile_factor: int = 40) -> DataFrame:
    """(_wg_id, _wg_words, _wg_component) for every row of ``docs``.

    With ``radius``, fingerprints link at that many differing bits over all words (the first word of several
    then screens pairs with a margin of over two deviations). Without, texts link whose shingle sets have a
    Jaccard similarity of at least ``similarity``, among all candidates within ``candidate_radius`` bits.
    """
    rows, named = _rooted(docs, id_col, text, shingle, words, similarity, radius, tile_factor)
    return rows.join(bounded_broadcast(named), "_wg_key").select("_wg_id", "_wg_words", "_wg_component")


@shielded
def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unique_ids: bool = True, shingle: int = 5, words: int = 4, similarity: float = 0.8, radius: int | None = None, tile_factor: int = 40) -> DataFrame:
    """``docs`` with one row of each group left, that of the smallest id (nulls last), then text hash; its own columns only.

    Ids may be null. With ``unique_ids``, of kept rows of several groups that share an id (not null) one stays;
    without, ids may repeat as well and every group keeps its row.
    """
    rows, named = _rooted(docs, id_col, text, shingle, words, similarity, radius, tile_factor)
    place = F.struct(F.col("_wg_id").isNull().alias("none"), "_wg_id", "_wg_text")
    chosen = rows.join(bounded_broadcast(named), "_wg_key").groupBy("_wg_root").agg(F.min(place).alias("kept"))
    chosen = durable(chosen.select(F.col("kept._wg_id").alias("_wg_kept"), F.col("kept._wg_text").alias("_wg_kept_text")))
    keyed = docs.withColumns({"_wg_id": F.col(id_col).cast("long"), "_wg_text": F.xxhash64(text_of(text))})
    kept = keyed.join(chosen, F.col("_wg_id").eqNullSafe(F.col("_wg_kept")) & (F.col("_wg_text") == F.col("_wg_kept_text")), "left_semi")
    # Rows that repeat id and text are one group's.
    apart = F.when(F.col("_wg_id").isNull(), F.col("_wg_text")) if unique_ids else F.col("_wg_text")
    first = W.partitionBy("_wg_id", apart).orderBy("_wg_text")
    return kept.withColumn("_wg_n", F.row_number().over(first)).filter("_wg_n = 1").select(*docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = near_groups(docs, shingle=4, words=1, radius=4)
    return groups.select(F.col("_wg_id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("_wg_words")[0]), 16, "0")).alias("fingerprint"), F.col("_wg_component").alias("component_id"))
