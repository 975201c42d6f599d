"""Metrics over measured values: exact, by integer arithmetic, never interpolated."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ordering import exact_percentile


def time_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, total, mean, p50, p95, p99) of an integer column; nulls do not count.

    The mean is an integer division, a percentile is ``sorted[n * p / 100]``.
    """
    s = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sort_array(F.collect_list(value)).alias("_s"))
    ranks = {f"p{p}": F.coalesce(exact_percentile(F.col("_s"), p), F.lit(0)) for p in (50, 95, 99)}
    mean = F.when(F.col("n") > 0, F.expr("total div n")).otherwise(0)
    return s.select(*by, "n", F.coalesce("total", F.lit(0)).cast("long").alias("total"), mean.cast("long").alias("mean"), *(c.cast("long").alias(k) for k, c in ranks.items()))


def large_time_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``time_stats`` for groups too large for one row: ranks come from counts per distinct value.

    A group's rows are first combined to (value, count) on the map side; what a task orders is a group's
    distinct values.
    """
    from pyspark.sql import Window as W

    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumns({"_upto": F.sum("_c").over(upto), "n": F.sum("_c").over(W.partitionBy(*by)), "total": F.sum(F.col("_v") * F.col("_c")).over(W.partitionBy(*by))})
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.col("n") * p / 100), F.col("_v")))
    return ranked.groupBy(*by, "n", "total").agg(*(at(p).cast("long").alias(f"p{p}") for p in (50, 95, 99))).select(*by, "n", F.col("total").cast("long").alias("total"), F.expr("total div n").cast("long").alias("mean"), "p50", "p95", "p99")


def latest(df: DataFrame, key: Column, order: Column, value: Column) -> DataFrame:
    """(key, value): of several writes to a key the last one counts."""
    return df.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"))


@dataclass
class MetricsCollector:
    """Driver-side record of a run's own figures: a few numbers a file or epoch, last write wins."""

    parse_micros: dict[str, int] = field(default_factory=dict)
    scan_micros: int = 0
    epoch_bytes: dict[int, int] = field(default_factory=dict)
    reparsed: int = 0

    def record_parse(self, file_id: str, micros: int) -> None:
        self.parse_micros[file_id] = micros

    def record_scan(self, micros: int) -> None:
        self.scan_micros = micros

    def record_epoch_memory(self, epoch_id: int, size: int) -> None:
        self.epoch_bytes[epoch_id] = size

    def record_reparsed(self, files: int) -> None:
        self.reparsed = files

    def total_memory(self) -> int:
        return sum(self.epoch_bytes.values())

    def parse_stats(self) -> dict[str, int]:
        s = sorted(self.parse_micros.values())
        n = len(s)
        pick = lambda p: s[n * p // 100] if n else 0
        return {"n": n, "total": sum(s), "mean": sum(s) // n if n else 0, "p50": s[n // 2] if n else 0, "p95": pick(95), "p99": pick(99)}

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.parse_micros.items()), "file_id string, micros long")

    def summary(self) -> str:
        p = self.parse_stats()
        return "\n".join([f"files parsed: {p['n']}, {p['total']} us (mean {p['mean']}, p50 {p['p50']}, p95 {p['p95']}, p99 {p['p99']})", f"scan: {self.scan_micros} us", f"reparsed: {self.reparsed}", f"epochs: {len(self.epoch_bytes)}, {self.total_memory()} bytes"])
