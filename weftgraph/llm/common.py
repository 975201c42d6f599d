"""Expressions and helpers that several corpus operators share. Internal columns start with ``_wg_``."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words and white space are defined on ASCII white space alone.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator(docs, ...)`` for rows that may have columns named like internal ones.

    Such a column passes through, unless the operator returns one of the same name: then that one stands.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        clash = {c: f"_weft_in{i}" for i, c in enumerate(docs.columns) if c.lower().startswith("_wg_")}
        if not clash:
            return operator(docs, *args, **kwargs)
        out = operator(docs.withColumnsRenamed(clash), *args, **kwargs)
        lost = {c for c in clash if c.lower() in (x.lower() for x in out.columns)}
        return out.drop(*(clash[c] for c in lost)).withColumnsRenamed({v: k for k, v in clash.items() if k not in lost})

    return run


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip_ascii(text: Column) -> Column:
    """Without ASCII white space at both ends; linear in the text, however long its inner blanks run."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def shuffle_key(row_id: Column) -> Column:
    """A pseudo-random order of rows that any engine can repeat: hex MD5 of the decimal id."""
    return F.md5(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary"))


def key_bucket(key: Column) -> Column:
    """First three hex digits: 4,096 ranges in key order, so a hot group is dealt over 4,096 tasks."""
    return F.substring(key, 1, 3)


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """128 bits as two XXH64 values of different seeds (64 would collide among 10^12 keys)."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("wide"), *cols)


def running_total(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``groups``, in the order (bucket, *order).

    Two levels: sums per (group, bucket) are made before the shuffle and summed up over at most 4,096
    rows a group; rows meet only others of their bucket. No task holds a whole hot group.
    """
    keys = [*groups, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_wg_total"))
    earlier = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_wg_total").over(earlier), F.lit(0)).alias("_wg_before"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(offsets, keys).withColumn(out, F.col("_wg_before") + F.sum(value).over(inside)).drop("_wg_before")


def bounded_broadcast(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; beyond that the plain, shuffled join."""
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(max_rows + 1).collect()) <= max_rows else df


def values_of(column: pa.Array, step: int = 64) -> Iterator:
    """Python values of an Arrow column, few at a time: a batch of long texts is never held twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()
