"""Mixing sources to target weights by weighted fair queueing.

Within a source, documents stand in a fixed pseudo-random order, repeated epoch by epoch. A copy's
virtual finish time is the source's words up to and with it, divided by the source's target. All copies
are range-partitioned by that time and the queue is cut where the running total reaches the budget.

Ranges of time are fixed (1/4,096 of a unit), so no sampling decides them: their sums say which range
holds the cut, and only that range is sorted. Running sums go over 4,096 key ranges a source, so a source
with a third of all rows is dealt over as many tasks.

Defined results: null text has size 0; a null source is a source of its own, ranked last; documents of
size 0 bring no words and stay or go by their place in the queue (they go if their whole source has none); equal ids are ordered by size; reruns agree whatever the partitioning.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions.durable import durable
from weftgraph.llm.common import bounded_broadcast, count_words, key_bucket, running_total, shielded, shuffle_key, text_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
RANGES = 4096


def _ranked(total: DataFrame) -> DataFrame:
    """``total`` with ``_wg_idx``, its row's place by source in code-point order, null last; no task sees all rows."""
    dealt = total.withColumn("_wg_null", F.col("_wg_source").isNull()).repartitionByRange("_wg_null", "_wg_source")
    dealt = durable(dealt.withColumn("_wg_part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in dealt.groupBy("_wg_part").agg(F.count("*")).collect())  # a row per partition
    before = dict(zip((p for p, _ in counts), itertools.accumulate((n for _, n in counts), initial=0)))
    base = F.coalesce(*(F.when(F.col("_wg_part") == p, F.lit(n).cast("long")) for p, n in before.items()), F.lit(0).cast("long"))
    inside = F.row_number().over(W.partitionBy("_wg_part").orderBy("_wg_null", "_wg_source")) - 1
    return dealt.withColumn("_wg_idx", base + inside).drop("_wg_part", "_wg_null")


def source_targets(rows: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(_wg_source, _wg_source_size, _wg_idx, _wg_target) per source.

    Sources in code-point order, null last, take the weights in turn and share the budget, the sum of all
    sizes. No target exceeds ``repeats`` times its source's size; the excess goes to the others by weight.
    Water-filling: sources whose share reaches their cap are filled, the rest share what is left, until no more
    fill; each round is one aggregate over the sources, of which there may be many.
    """
    total = rows.groupBy("_wg_source").agg(F.sum("_wg_size").alias("_wg_source_size"))
    s = durable(_ranked(total).withColumns({"w": F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("_wg_idx") % len(weights) + 1).cast("int")), "cap": (repeats * F.col("_wg_source_size")).cast("double")}))
    budget, every = s.agg(F.coalesce(F.sum("_wg_source_size").cast("double"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    filled = held = 0.0  # caps and weights of the sources that are full
    while True:
        full = (F.lit(budget) - filled) * F.col("w") >= F.col("cap") * (F.lit(every) - held)
        c, w = s.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(full, F.col("w"))), F.lit(0.0))).first()
        if (c, w) == (filled, held) or w == every:
            break
        filled, held = c, w
    if w == every:  # all are full
        full, filled, held = F.lit(True), 0.0, 0.0
    target = F.when(full, F.col("cap")).otherwise(F.try_divide(F.col("w") * (F.lit(budget) - filled), F.lit(every) - held))
    return s.select("_wg_source", "_wg_source_size", "_wg_idx", target.alias("_wg_target"))


def _place(epoch: int) -> Column:
    """The copy's place in the queue: finish time, then source, epoch and key."""
    time = F.try_divide((F.lit(epoch) * F.col("_wg_source_size") + F.col("_wg_cum")).cast("double"), F.col("_wg_target"))  # null: a source without words
    return F.struct(time.alias("t"), F.col("_wg_idx").alias("s"), F.lit(epoch).alias("e"), F.col("_wg_key").alias("k"), F.col("_wg_cum").alias("c"))


def schedule(rows: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``rows`` (_wg_id, _wg_source, _wg_size and others) with target columns and ``_wg_copies``."""
    rows = durable(rows.withColumn("_wg_key", shuffle_key(F.col("_wg_id"))))
    targets = durable(source_targets(rows, weights, repeats))
    known = rows.join(bounded_broadcast(targets), rows["_wg_source"].eqNullSafe(targets["_wg_source"])).drop(targets["_wg_source"])
    known = durable(known.withColumn("_wg_bucket", key_bucket(F.col("_wg_key"))))
    queue = durable(running_total(known, ["_wg_idx"], "_wg_bucket", ["_wg_key", "_wg_size"], F.col("_wg_size"), "_wg_cum"))
    span = lambda t: F.least(F.floor(t * RANGES), F.lit(repeats * RANGES)).cast("long")
    copies = queue.select("_wg_size", F.explode(F.array(*(_place(e) for e in range(repeats)))).alias("p")).filter("p.t IS NOT NULL").withColumn("r", span(F.col("p.t")))
    sums = sorted(tuple(x) for x in copies.groupBy("r").agg(F.sum("_wg_size")).collect())  # repeats * RANGES + 1 rows at most
    budget, before, cut = queue.agg(F.coalesce(F.sum("_wg_size"), F.lit(0))).first()[0], 0, None
    for r, n in sums:
        if before + n > budget:
            cut = r
            break
        before += n
    taken = lambda e: _place(e)["t"].isNotNull()
    if cut is not None:
        place = W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)
        edge = copies.filter(F.col("r") == cut).withColumn("sum", F.sum("_wg_size").over(place)).filter(F.col("sum") + before <= budget).agg(F.max("p").alias("p")).first()["p"]
        last = None if edge is None else F.struct(F.lit(edge["t"]).alias("t"), F.lit(edge["s"]).cast("long").alias("s"), F.lit(edge["e"]).alias("e"), F.lit(edge["k"]).alias("k"), F.lit(edge["c"]).cast("long").alias("c"))
        taken = lambda e: F.coalesce((span(_place(e)["t"]) < cut) | (F.lit(False) if last is None else (span(_place(e)["t"]) == cut) & (_place(e) <= last)), F.lit(False))
    return queue.withColumn("_wg_copies", reduce(lambda a, b: a + b, (taken(e).cast("int") for e in range(repeats))))


def _rows(docs: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_wg_id"), F.col(source).cast("string").alias("_wg_source"), count_words(text_of(text)).alias("_wg_size"), F.xxhash64(text_of(text)).alias("_wg_row"))


@shielded
def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it; its own columns only.

    Rows equal in id, source and text count as one unit here, taken or left together.
    """
    unit = ["_wg_id", "_wg_source", "_wg_row"]
    units = _rows(docs, id_col, source, text).groupBy(*unit).agg(F.sum("_wg_size").alias("_wg_size"))
    plan = schedule(units, weights, repeats).filter("_wg_copies > 0").select(*(F.col(c).alias(f"{c}_plan") for c in unit), "_wg_copies")
    keyed = docs.withColumns({"_wg_id": F.col(id_col).cast("long"), "_wg_source": F.col(source).cast("string"), "_wg_row": F.xxhash64(text_of(text))})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_plan")) for c in unit[:2]), F.col("_wg_row") == F.col("_wg_row_plan"))
    return keyed.join(plan, same).withColumn("_wg_copy", F.explode(F.sequence(F.lit(1), F.col("_wg_copies")))).select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = schedule(_rows(docs, "doc_id", "source", "text"))
    return plan.select(F.col("_wg_id").alias("doc_id"), F.col("_wg_size").alias("size"), F.col("_wg_source_size").alias("source_size"), F.col("_wg_target").alias("target"), (F.col("_wg_size") * F.col("_wg_copies")).alias("taken"))


ORACLE_SQL = r"""
WITH b AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM b GROUP BY source),
s1 AS (SELECT *, CAST(CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS b, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
         coalesce(sum(w) OVER (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0 FROM s1),
s3 AS (SELECT *, (b - c0) * w >= cap * (all_w - w0) AS is_full FROM s2),
s4 AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS c, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS cw FROM s3),
t AS (SELECT source, source_size, idx, CASE WHEN is_full THEN cap ELSE w * (b - c) / (all_w - cw) END AS target FROM s4),
q AS (SELECT b.*, t.source_size, t.idx, t.target, sum(size) OVER (PARTITION BY idx ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS cum FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, e, CASE WHEN target > 0 THEN CAST(e * source_size + cum AS DOUBLE) / target END AS v FROM q, (SELECT unnest([0, 1, 2]) AS e)),
r AS (SELECT *, sum(CASE WHEN v IS NULL THEN 0 ELSE size END) OVER (ORDER BY v NULLS LAST, idx, e, k, cum ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN v IS NOT NULL AND run <= (SELECT sum(size) FROM b) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY doc_id, source, k, size, source_size, target, cum
"""
