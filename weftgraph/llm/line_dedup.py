"""Line dedup over levelled sorted runs of line hashes.

``SortedRuns`` is a log-structured index: each batch of documents contributes one run (line hash ->
smallest owner) as a bucketed, sorted table; runs of a level are merged into one of the next level once
``fanout`` of them exist. A new batch is merge-anti-joined with the runs - only the batch is shuffled and
sorted, the runs are read bucket by bucket in their order - and the keys that no run has become the newest run.

Batches are taken in ascending id, so the owner that a run holds is the smallest id of all.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` are never
dropped; a null id ranks after every other id, and all null ids count as one document; rows that repeat
an id are one document; extra columns pass through.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.durable import Scratch, durable, settings
from weftgraph.llm.common import ascii_lower, bounded_broadcast, shielded, strip_ascii, text_of, wide_hash

LAST_ID = 2**63 - 1
KEYS = ("_wg_k1", "_wg_k2")


class SortedRuns:
    """Levels of runs; every run is a table bucketed by the 128-bit key, one sorted file a bucket, with its owner.

    Plans made within ``reading`` take a run as it lies: no exchange and no sort stands above its scan.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def reading(self):
        """Settings for eager steps over runs: a bucket's one file is in order, plans keep their partitioning."""
        return settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering=True, spark__sql__adaptive__enabled=False, spark__sql__shuffle__partitions=self.buckets)

    def resolve(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``_wg_seen``: the owner in some run, null for a new key. Runs are disjoint."""
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.select(*KEYS, F.col("_wg_owner").alias(f"_wg_seen{i}")).hint("merge"), list(KEYS), "left")
        seen = [F.col(f"_wg_seen{i}") for i in range(len(self.runs()))]
        return keys.withColumn("_wg_seen", F.coalesce(*seen, F.lit(None).cast("long"))).drop(*(f"_wg_seen{i}" for i in range(len(seen))))

    def _write(self, df: DataFrame) -> str:
        """A run of rows whose partitions are the buckets."""
        name = f"weft_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
        return name

    def add(self, run: DataFrame) -> None:
        """A new run at level 0; a full level is compacted into the next."""
        with self.reading():
            self._push(0, self._write(run.repartition(self.buckets, *KEYS)))

    def _merge(self, a: str, b: str) -> str:
        """Two disjoint runs as one: a merge join of their sorted buckets."""
        x, y = (self.spark.table(n).withColumnRenamed("_wg_owner", f"_wg_owner{i}") for i, n in enumerate((a, b)))
        both = x.join(y.hint("merge"), list(KEYS), "full_outer")
        merged = self._write(both.select(*KEYS, F.coalesce("_wg_owner0", "_wg_owner1").alias("_wg_owner")))
        self._drop([a, b])
        return merged

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, reduce(self._merge, full))

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")

    def drop(self) -> None:
        self._drop([x for level in self.levels for x in level])
        self.levels = []


def _bounds(ids: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal counts (at most ``batches`` - 1 numbers)."""
    cuts = ids.select(F.percentile_approx("_wg_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    return sorted(set(cuts or []))


def repeated_lines(docs: DataFrame, id_col: str, text: str, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """(_wg_row, _wg_id, _wg_drop): for each document with lines to drop, their sorted positions."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_wg_id"), text_of(text).alias("_wg_text"))
    cuts = _bounds(slim.select("_wg_id"), batches)
    batch = reduce(lambda c, x: c + (F.col("_wg_id") > x).cast("int"), cuts, F.lit(0))
    lines = slim.select("_wg_id", F.xxhash64("_wg_text").alias("_wg_row"), batch.alias("_wg_batch"), F.posexplode(F.split("_wg_text", "\n", -1)).alias("_wg_at", "_wg_line"))
    lines = lines.withColumn("_wg_line", ascii_lower(strip_ascii(F.col("_wg_line")))).filter(F.length("_wg_line") >= min_chars)
    lines = lines.withColumns(dict(zip(KEYS, wide_hash(F.col("_wg_line"))))).drop("_wg_line")
    stored = scratch.store(lines, "_wg_batch")
    runs, dropped = SortedRuns(spark, fanout=fanout), []
    try:
        for b in range(len(cuts) + 1):
            own = stored.filter(F.col("_wg_batch") == b)
            keys = own.groupBy(*KEYS).agg(F.min("_wg_id").alias("_wg_own"), F.max("_wg_id").alias("_wg_last"))
            with runs.reading():
                known = durable(runs.resolve(keys))
            if b < len(cuts):  # no batch reads what the last one adds
                runs.add(known.filter(F.col("_wg_seen").isNull()).select(*KEYS, F.col("_wg_own").alias("_wg_owner")))
            shared = known.filter(F.col("_wg_seen").isNotNull() | (F.col("_wg_own") < F.col("_wg_last"))).select(*KEYS, F.coalesce("_wg_seen", "_wg_own").alias("_wg_owner"))
            hits = own.join(bounded_broadcast(shared), list(KEYS)).filter(F.col("_wg_id") > F.col("_wg_owner"))
            dropped.append(hits.groupBy("_wg_row", "_wg_id").agg(F.sort_array(F.collect_set("_wg_at")).alias("_wg_drop")))
        return durable(reduce(DataFrame.unionByName, dropped))
    finally:
        runs.drop()
        scratch.drop()


def _without(lines: Column, drop: Column) -> Column:
    """The lines between dropped positions, by slices: linear in the text however many lines go."""
    cut = lambda s: F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(s["drop"])),
            lambda k: F.slice(s["lines"], F.coalesce(F.get(s["drop"], k - 1), F.lit(-1)) + 2, F.coalesce(F.get(s["drop"], k), F.size(s["lines"])) - F.coalesce(F.get(s["drop"], k - 1), F.lit(-1)) - 1),
        )
    )
    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), drop.alias("drop"))), cut), 1)


@shielded
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``_wg_n_lines`` and ``_wg_n_dropped``.

    A line's key (stripped, A-Z lower-cased) of at least ``min_chars`` code points that two documents
    share stays only in the document of the smallest id.
    """
    dropped = repeated_lines(docs, id_col, text, min_chars, batches, fanout)
    t = text_of(text)
    keyed = docs.withColumns({"_wg_row": F.xxhash64(t), "_wg_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))})
    joined = keyed.join(dropped, ["_wg_row", "_wg_id"], "left")
    split = F.split(t, "\n", -1)
    kept = F.when(F.col("_wg_drop").isNull(), t).otherwise(F.array_join(_without(split, F.col("_wg_drop")), "\n"))
    counts = {"_wg_n_lines": F.size(split).cast("long"), "_wg_n_dropped": F.coalesce(F.size("_wg_drop"), F.lit(0)).cast("long")}
    return joined.withColumns(counts | {text: kept}).select(*docs.columns, *counts)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_wg_n_lines").alias("n_lines"), F.col("_wg_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
j AS (SELECT k.*, o.owner IS NOT NULL AND k.doc_id > o.owner AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
