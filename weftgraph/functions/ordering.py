"""Dense ids and ordered aggregates without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dense_ids(df: DataFrame, coarse: Sequence[str], fine: Sequence[str | Column], out: str, start: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """``out`` = position of the row in the order (coarse, fine), from ``start``; per ``within`` if given.

    ``coarse`` names columns that cut the order into many ranges; the first has few values (a kind, the
    first digits of a hash). Rows are ranked inside their range; only the ranges' counts (one row each)
    are summed up in order. Ties in (coarse, fine) are for the caller to exclude. Null-safe.
    """
    keys = [*within, *coarse]
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*fine)))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = lambda part, order: F.coalesce(F.sum("_n").over(W.partitionBy(*part).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if len(coarse) == 1:
        counts = counts.withColumn("_before", before(within, coarse))
    else:  # ranges of the first column, then those within it: no window sees all ranges
        head = [*within, coarse[0]]
        tops = counts.groupBy(*head).agg(F.sum("_n").alias("_n")).withColumn("_top", before(within, coarse[:1])).drop("_n")
        tops = tops.select(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(head)), "_top")
        counts = counts.withColumn("_in", before(head, coarse[1:])).join(tops, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(head)])
        counts = counts.withColumn("_before", F.col("_top") + F.col("_in"))
    offsets = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before")
    joined = ranked.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return joined.withColumn(out, F.col("_before") + F.col("_rank") - 1 + start).drop("_rank", "_before", *(f"_k{i}" for i in range(len(keys))))


def ordered_list(order: Column | Sequence[Column], value: Column) -> Column:
    """Values of the group in order: collected with their order columns, sorted, stripped."""
    cols = list(order) if isinstance(order, (list, tuple)) else [order]
    pairs = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(cols)), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def joined_list(order: Column | Sequence[Column], value: Column, sep: str = ",") -> Column:
    """``ordered_list`` as one string: the same in every engine."""
    return F.array_join(ordered_list(order, value.cast("string")), sep)


def exact_percentile(sorted_values: Column, percent: int) -> Column:
    """``sorted[n * percent / 100]`` by integer division: an element, never interpolated; null if empty."""
    return F.get(sorted_values, (F.size(sorted_values) * percent / 100).cast("int"))
