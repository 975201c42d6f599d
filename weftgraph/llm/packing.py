"""Best-fit packing under conflicts: no two documents of one source or one duplicate cluster share a bin.

Documents are dealt by a hash over packers of about ``per_packer`` documents each, whatever their source
or cluster, so no group decides a task's size. A packer takes its pieces in descending size. Open bins are
ordered by residual room and carry one bitmap of the sources and duplicate clusters in them; the search
takes the smallest sufficient residual and moves to its successor until a bin's bitmap has none of the
piece's bits. Bins of equal residual and bitmap stand together and are tested once; frequent sources and
clusters also keep an index of the residuals at which some bin lacks them, so a source with a third of all
documents does not walk over every bin that has it.

A text longer than a bin is cut: full pieces get bins of their own, the rest is packed as a piece.

Defined results: documents without words (null, empty) have one row with a null bin; a null source is a
source like any other; repeated rows are one cluster and so lie in different bins; each piece is in exactly
one bin; reruns agree.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.llm.common import SPACE, ascii_lower, count_words, text_of, wide_hash

CAPACITY = 2048
HOT_SHARE = 64


class Bins:
    """The open bins of one packer."""

    def __init__(self, capacity: int, hot: Iterable[int]):
        self.capacity = capacity
        self.room: list[int] = []
        self.mask: list[int] = []
        self.at: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(capacity + 1)]  # residual -> bitmap -> bins
        self.open = 0  # bit r: some bin has residual r
        self.lacking = {bit: 0 for bit in hot}  # bit of a frequent group -> residuals at which some bin lacks it
        self.lack_count = {bit: Counter() for bit in self.lacking}

    def _put(self, b: int) -> None:
        r, m = self.room[b], self.mask[b]
        bins = self.at[r].setdefault(m, [])
        if not bins:
            self.open |= 1 << r
            for bit in self.lacking:
                if not m & bit:
                    self.lack_count[bit][r] += 1
                    self.lacking[bit] |= 1 << r
        bins.append(b)

    def _take(self, r: int, m: int) -> int:
        bins = self.at[r][m]
        b = bins.pop()
        if not bins:
            del self.at[r][m]
            if not self.at[r]:
                self.open &= ~(1 << r)
            for bit in self.lacking:
                if not m & bit:
                    self.lack_count[bit][r] -= 1
                    if not self.lack_count[bit][r]:
                        self.lacking[bit] &= ~(1 << r)
        return b

    def place(self, size: int, mask: int) -> tuple[int, int]:
        """(bin, offset) of a piece in the tightest bin that has room and no bit of ``mask``."""
        near = self.open
        for bit, held in self.lacking.items():
            if mask & bit:
                near &= held
        near >>= size
        r, b = size, None
        while near:
            step = (near & -near).bit_length() - 1
            r, near = r + step, near >> step
            found = next((m for m in self.at[r] if not m & mask), None)
            if found is not None:
                b = self._take(r, found)
                break
            r, near = r + 1, near >> 1
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.mask.append(0)
        offset = self.capacity - self.room[b]
        self.room[b] -= size
        self.mask[b] |= mask
        if self.room[b]:
            self._put(b)
        return b, offset


def pack_items(items: list[tuple], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, bin, offset, size) for items (row, size, source, cluster); sizes over 0."""
    groups = Counter(("s", x[2]) for x in items) + Counter(("c", x[3]) for x in items)
    bit = {g: 1 << i for i, g in enumerate(g for g, n in groups.items() if n > 1)}
    bins = Bins(capacity, [bit[g] for g, n in groups.items() if n > 1 and n * HOT_SHARE >= len(items)])
    out, rest = [], []
    for row, size, source, cluster in items:
        mask = bit.get(("s", source), 0) | bit.get(("c", cluster), 0)
        rest += [(size % capacity, row, size // capacity, mask)] if size % capacity else []
        for piece in range(size // capacity):
            out.append((row, piece, *bins.place(capacity, mask), capacity))
    rest.sort(key=lambda x: -x[0])  # stable: equal sizes keep the order of the items
    for size, row, piece, mask in rest:
        out.append((row, piece, *bins.place(size, mask), size))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", capacity: int = CAPACITY, per_packer: int = 4096) -> DataFrame:
    """(id, source, cluster, piece, size, bin, offset): one row per piece of ``docs``.

    Sizes are words. A duplicate cluster is one case-folded, space-normalised text.
    """
    t = text_of(text)
    cluster = wide_hash(F.regexp_replace(F.trim(F.regexp_replace(ascii_lower(t), SPACE, " ")), "^ | $", ""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source).cast("string").alias("source"), count_words(t).alias("size"), cluster[0].alias("c1"), cluster[1].alias("c2"))
    slim = durable(slim)
    packers = max(1, -(-slim.count() // per_packer))
    items = slim.filter("size > 0").withColumn("packer", F.pmod(F.xxhash64("id", "c2"), F.lit(packers)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "c1", "c2", "source", "size"], kind="stable", na_position="last").reset_index(drop=True)
        sources = pdf["source"].where(pdf["source"].notna(), None)
        placed = pack_items(list(zip(range(len(pdf)), pdf["size"].tolist(), sources.tolist(), zip(pdf["c1"].tolist(), pdf["c2"].tolist()))), capacity)
        row, piece, bins, offset, size = (list(x) for x in zip(*placed))
        out = pdf.iloc[row][["id", "source", "c1"]].reset_index(drop=True)
        base = int(pdf["packer"].iloc[0]) << 32
        return out.assign(piece=piece, size=size, bin=[base + b for b in bins], offset=offset)

    schema = "id long, source string, c1 long, piece int, size int, bin long, offset int"
    packed = items.groupBy("packer").applyInPandas(run, schema)
    none = slim.filter("size = 0").select("id", "source", "c1", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("offset"))
    return packed.unionByName(none).withColumnRenamed("c1", "cluster")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return pack(docs).withColumnRenamed("id", "doc_id")
