"""Edges prepared for level-by-level joins.

Edges are stored once, by column. A frontier of at most ``SMALL`` rows is broadcast: its level neither
moves nor sorts edges. For the first larger one the edges are dealt and sorted by ``src``, once, so that
such a level moves only its frontier. Nodes with more out-edges than a partition's fair share would make one task
of that partition; their edges (of at most as many nodes as there are partitions) are kept apart, undealt,
for a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.durable import Scratch, durable, durable_by

#: Fewer out-edges than this never make a hub.
LEAST = 100_000
#: Most rows of a frontier (a few ids each) that are broadcast.
SMALL = 200_000


class Hops:
    def __init__(self, edges: DataFrame, least: int = LEAST, small: int = SMALL):
        """``edges`` with ``src`` and any other columns."""
        self._scratch = Scratch(edges.sparkSession)
        self.edges, self.least, self.small = self._scratch.store(edges), least, small
        self.light = self.heavy = None

    def _deal(self) -> None:
        parts = int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        degree = self.edges.groupBy("src").agg(F.count("*").alias("n"))
        total = self.edges.count()
        limit = max(self.least, total // parts)
        hubs = [r["src"] for r in degree.filter(F.col("n") > limit).select("src").collect()] if total > limit else []  # below total / limit of them
        self.light = durable_by(self.edges.filter(~F.col("src").isin(hubs)) if hubs else self.edges, "src")
        if hubs:
            self.heavy = durable(self.edges.filter(F.col("src").isin(hubs)).repartition(parts))

    def step(self, level: DataFrame, node: str, rows: int) -> DataFrame:
        """``level``, of so many ``rows``, joined with the edges that leave its ``node``."""
        if rows <= self.small:
            return self.edges.join(F.broadcast(level), self.edges["src"] == level[node])
        if self.light is None:
            self._deal()
        join = lambda e: level.join(e, level[node] == e["src"])
        return join(self.light) if self.heavy is None else join(self.light).unionByName(join(self.heavy))

    def drop(self) -> None:
        """Removes the stored edges; levels that are durable do not need them."""
        self._scratch.drop()
