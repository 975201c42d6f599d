"""Snapshot diff and incremental invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(file_id, change) of two file tables (file_id, content_hash): Added, Deleted, Modified or Unchanged.

    One full outer join on the id; a null hash differs from any other hash.
    """
    p = previous.select("file_id", F.col("content_hash").alias("before"), F.lit(True).alias("had"))
    c = current.select("file_id", F.col("content_hash").alias("after"), F.lit(True).alias("has"))
    kind = F.when(F.col("had").isNull(), "Added").when(F.col("has").isNull(), "Deleted").when(F.col("before").eqNullSafe(F.col("after")), "Unchanged").otherwise("Modified")
    return p.join(c, "file_id", "full_outer").select("file_id", kind.alias("change"))


def reparse_set(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(file_id): files whose (id, hash) the tree cache lacks, that is, Added or Modified ones."""
    return current.join(previous.select("file_id", "content_hash"), ["file_id", "content_hash"], "left_anti").select("file_id")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open ranges overlap; touching ones do not; equal ones (also empty) do."""
    return ((a_end > b_start) & (b_end > a_start)) | ((a_start == b_start) & (a_end == b_end))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows of ``a(keys, range_start, range_end)`` and ``b(keys, start, end)`` that overlap.

    An interval join without a nested loop: every range is put into the bins of ``width`` that it
    touches, bins are an equi-join, and a pair is kept only in the bin in which the later of its two
    starts lies, so nothing needs to be deduplicated.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width)))
    x = a.withColumn("_bin", bins(F.col("range_start"), F.col("range_end")))
    y = b.withColumn("_bin", bins(F.col("start"), F.col("end")))
    home = F.floor(F.greatest("range_start", "start") / width) == F.col("_bin")
    return x.join(y, [*keys, "_bin"]).filter(home & overlaps(F.col("range_start"), F.col("range_end"), F.col("start"), F.col("end"))).drop("_bin")


def invalidated_nodes(ast_to_cfg: DataFrame, changed: DataFrame, keys: list[str] | None = None, width: int = 256) -> DataFrame:
    """(keys, node_id): distinct nodes whose tracked range equals or overlaps a changed one."""
    keys = keys or []
    a, b = (ast_to_cfg, changed) if keys else (ast_to_cfg.withColumn("_all", F.lit(0)), changed.withColumn("_all", F.lit(0)))
    return overlap_join(a, b, keys or ["_all"], width).select(*keys, "node_id").distinct()


def invalidated_edges(nodes: DataFrame, cfg_to_dfg: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, edge_id): distinct data-flow edges tracked for the invalidated nodes."""
    on = [*(keys or []), "node_id"]
    return nodes.join(cfg_to_dfg, on).select(*(keys or []), "edge_id").distinct()


def invalidation_stats(ast_to_cfg: DataFrame, cfg_to_dfg: DataFrame) -> DataFrame:
    """(ast_mappings, cfg_mappings): tracked ranges and tracked nodes."""
    a = ast_to_cfg.agg(F.count_distinct("range_start", "range_end").alias("ast_mappings"))
    return a.crossJoin(cfg_to_dfg.agg(F.count_distinct("node_id").alias("cfg_mappings")))  # one row each
