"""Resharding as a minimum-cost flow: move the fewest bytes from old shards to new capacities.

Shard sizes are a handful of sums, so the transport problem is solved on the driver by successive
shortest paths. Its flows cut each old shard's bytes, in a fixed pseudo-random order of documents, into
blocks that stay or go; only files of shards that gain or lose a block are rewritten.

Defined results: a null text has no bytes (size 1 and CRC 0); null ids sort together; repeated rows are
placed one by one, in the order of size and CRC; the law is ``bytes``: new shards differ from their
capacity by less than one document at each block's edge.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.llm.common import key_bucket, running_total, shuffle_key

SHARDS = 8
OLD_SHARDS = 6


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Flows from supplies to capacities of least total cost, by successive shortest paths with potentials.

    Ties are broken by node number, so equal input gives equal flows. ``sum(capacity) >= sum(supply)``.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edge: to, room, cost, its reverse

    def edge(u: int, v: int, room: int, c: int) -> None:
        graph[u].append([v, room, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    for i in range(n):
        edge(source, i, supply[i], 0)
        for j in range(m):
            edge(i, n + j, supply[i], cost[i][j])
    for j in range(m):
        edge(n + j, sink, capacity[j], 0)
    height = [0] * len(graph)
    left = sum(supply)
    while left:
        far, via = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k, (v, room, c, _) in enumerate(graph[u]):
                if room and (new := d + c + height[u] - height[v]) < far.get(v, 1 << 62):
                    far[v], via[v] = new, (u, k)
                    heapq.heappush(heap, (new, v))
        if sink not in far:
            raise ValueError("capacities are smaller than the data")
        for u, d in far.items():
            height[u] += d
        push, v = left, sink
        while v != source:
            u, k = via[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = via[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
        left -= push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, room, _, _ in graph[i]:
            if n <= v < n + m:
                flow[i][v - n] = supply[i] - room
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _destination(flow: list[list[int]]) -> Column:
    """New shard of the byte that starts at ``_wg_cum - _wg_size`` of old shard ``_wg_old``."""
    start, out = F.col("_wg_cum") - F.col("_wg_size"), F.lit(None).cast("int")
    for i, row in enumerate(flow):
        stay_first = sorted((j for j in range(len(row)) if row[j]), key=lambda j: (j != i, j))
        within, upto = F.lit(stay_first[-1] if stay_first else 0), sum(row)
        for j in reversed(stay_first):
            within, upto = F.when(start < upto, F.lit(j)).otherwise(within), upto - row[j]
        out = F.when(F.col("_wg_old") == i, within).otherwise(out)
    return out.cast("int")


def reshard(rows: DataFrame, shards: int, old_shards: int, capacities: Sequence[int] | None = None, cost: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """``rows`` (_wg_id, _wg_old, _wg_size, _wg_crc) with ``_wg_shard`` and its gapless ``_wg_slot``.

    ``cost[i][j]`` prices a byte moved from old shard i to new shard j; by default 0 to stay and 1 to move.
    """
    key = shuffle_key(F.col("_wg_id"))
    rows = durable(rows.withColumns({"_wg_key": key, "_wg_bucket": key_bucket(key)}))
    held = dict(rows.groupBy("_wg_old").agg(F.sum("_wg_size")).collect())  # a row per old shard
    supply = [held.get(i, 0) for i in range(old_shards)]
    room = list(capacities) if capacities is not None else equal_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, room, cost or [[int(i != j) for j in range(shards)] for i in range(old_shards)])
    order = ["_wg_key", "_wg_size", "_wg_crc"]
    placed = running_total(rows, ["_wg_old"], "_wg_bucket", order, F.col("_wg_size"), "_wg_cum").withColumn("_wg_shard", _destination(flow))
    return running_total(durable(placed), ["_wg_shard"], "_wg_bucket", order, F.lit(1), "_wg_rank").withColumn("_wg_slot", F.col("_wg_rank") - 1)


def as_rows(docs: DataFrame, old: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    raw = F.col(text).cast("string").cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("_wg_id"), old.cast("int").alias("_wg_old"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("_wg_size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("_wg_crc"))


def rewrite(spark: SparkSession, path: str, out: str, shards: int, id_col: str = "doc_id", text: str = "text") -> list[int]:
    """Reshards a data set laid out as ``path/shard=K`` into ``out``; returns the shards that were rewritten.

    ``out`` receives only the files of shards whose rows changed; the others are valid where they lie.
    Rows are matched by id, size and CRC; rows equal in all three are equal for this purpose.
    """
    docs = spark.read.parquet(path)
    old = docs.agg(F.max("shard")).first()[0]
    plan = reshard(as_rows(docs, F.col("shard"), id_col, text), shards, 1 + (old or 0))
    one = durable(plan.groupBy("_wg_id", "_wg_size", "_wg_crc").agg(F.min("_wg_shard").alias("_wg_shard")))
    raw = F.col(text).cast("string").cast("binary")
    keyed = docs.withColumns({"_wg_i": F.col(id_col).cast("long"), "_wg_s": (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long"), "_wg_c": F.coalesce(F.crc32(raw), F.lit(0)).cast("long")})
    moved = keyed.join(one, F.col("_wg_i").eqNullSafe(F.col("_wg_id")) & (F.col("_wg_s") == F.col("_wg_size")) & (F.col("_wg_c") == F.col("_wg_crc")))
    changed = sorted({x for r in moved.filter("shard <> _wg_shard").select("shard", "_wg_shard").distinct().collect() for x in r})
    final = moved.withColumn("shard", F.col("_wg_shard")).filter(F.col("shard").isin([x for x in changed if x < shards])).select(*docs.columns)
    final.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(64))).write.partitionBy("shard").parquet(out)
    return changed


def op7_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 6 old shards, dealt by source and so uneven, to 8 of equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    old = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    placed = reshard(as_rows(docs, old), SHARDS, OLD_SHARDS)
    return placed.select(
        F.col("_wg_id").alias("doc_id"), F.col("_wg_size").alias("size"), F.col("_wg_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_wg_shard").alias("shard"),
        F.col("_wg_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_wg_old").alias("old_shard"),
    )
