"""Bounded points-to analysis: a semi-naive fixpoint over DataFlow edges.

Sets are long tables (value, target). A set over ``MAX_SET`` targets becomes Unknown: its targets go, it
stops to contribute, and the analysis is no longer complete. Overflow is judged per round, after all of the
round's facts are in; without overflow the result is the least fixpoint and independent of any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.durable import durable
from weftgraph.operators.hops import Hops

MAX_SET, MAX_ROUNDS = 100, 100
#: Rounds whose facts are written together into one table.
COMPACT = 16


@dataclass(frozen=True)
class PointsTo:
    """``values(value)``, ``facts(value, target)`` of known sets, ``unknown(value)``, and completeness."""

    values: DataFrame
    facts: DataFrame
    unknown: DataFrame
    complete: bool

    def sets(self) -> DataFrame:
        """(value, n_targets, is_unknown) for every analysed value; an Unknown set counts null."""
        n = self.facts.groupBy("value").agg(F.count("*").alias("n"))
        u = self.unknown.select("value", F.lit(True).alias("u"))
        rows = self.values.join(n, "value", "left").join(u, "value", "left")
        return rows.select("value", F.when(F.col("u").isNull(), F.coalesce("n", F.lit(0))).cast("long").alias("n_targets"), F.col("u").isNotNull().alias("is_unknown"))

    def of(self, value: int) -> DataFrame:
        """(target) of one value."""
        return self.facts.filter(F.col("value") == value).select("target")

    def stats(self) -> DataFrame:
        """(analyzed, known, unknown, points_to_edges, completed)."""
        s = self.sets()
        return s.agg(F.count("*").alias("analyzed"), F.count_if(~F.col("is_unknown")).alias("known"), F.count_if("is_unknown").alias("unknown"), F.coalesce(F.sum("n_targets"), F.lit(0)).alias("points_to_edges")).withColumn("completed", F.lit(self.complete))


def analyze(values: DataFrame, edges: DataFrame, seed: str = "self", facts: DataFrame | None = None, max_set: int = MAX_SET, max_rounds: int = MAX_ROUNDS, propagate_unknown: bool = False) -> PointsTo:
    """Sets of ``values(value)`` along ``edges(src, dst)``: pts(dst) includes pts(src).

    ``seed='self'``: every value points to itself (allocation sites); ``'none'``: all sets start empty;
    ``facts(value, target)`` are added to either. With ``propagate_unknown`` an Unknown set makes its
    successors Unknown too.
    """
    if seed not in ("self", "none"):
        raise ValueError("seed is 'self' or 'none'")
    spark = values.sparkSession
    values = durable(values.select("value").distinct())
    flow = edges.select("src", "dst").distinct()
    flow = Hops(flow.join(values.select(F.col("value").alias("src")), "src", "left_semi").join(values.select(F.col("value").alias("dst")), "dst", "left_semi").select("src", "dst"))
    start = values.select("value", F.col("value").alias("target")).filter(F.lit(seed == "self"))
    if facts is not None:
        start = start.union(facts.select("value", "target").join(values, "value", "left_semi")).distinct()
    pts = delta = durable(start)
    unknown = spark.createDataFrame([], "value long")
    complete, rounds, n, parts = True, 0, delta.count(), 1
    while True:
        grown = flow.step(delta, "value", n).select(F.col("dst").alias("value"), "target").distinct()
        new = durable(grown.join(unknown, "value", "left_anti").join(pts, ["value", "target"], "left_anti"))
        n = new.count()
        if not n:
            break
        if rounds == max_rounds:
            complete = False
            break
        rounds += 1
        # After the first round only values that grew can overflow. Facts are appended by round and written together now and then.
        every, parts = pts.union(new), parts + 1
        grown = every if rounds == 1 else every.join(new.select("value").distinct(), "value", "left_semi")
        counts = grown.groupBy("value").agg(F.count("*").alias("n"))
        over = durable(counts.filter(F.col("n") > max_set).select("value"))
        if over.isEmpty():
            pts, delta, parts = (every, new, parts) if parts < COMPACT else (durable(every), new, 1)
            continue
        complete = False
        unknown = durable(unknown.union(over))
        if propagate_unknown:
            unknown = _closure(unknown, flow)
        pts, delta, parts = durable(every.join(unknown, "value", "left_anti")), durable(new.join(unknown, "value", "left_anti")), 1
        n = delta.count()
    flow.drop()
    return PointsTo(values, pts, unknown, complete)


def _closure(start: DataFrame, flow: Hops) -> DataFrame:
    seen = level = start
    while True:
        step = flow.step(level, "value", level.count()).select(F.col("dst").alias("value")).distinct()
        level = durable(step.join(seen, "value", "left_anti"))
        if level.isEmpty():
            return durable(seen)
        seen = seen.union(level)
