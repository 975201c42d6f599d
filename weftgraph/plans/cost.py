"""Cost estimate and plan cache."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QueryCost:
    node_count: int
    fanout: float
    depth: int
    selectivity: float

    def estimate(self) -> float:
        return self.node_count * self.fanout * self.depth * (1.0 - self.selectivity)


def cost(node_count: Column, fanout: Column, depth: Column, selectivity: Column) -> Column:
    """nodes x fanout x depth x (1 - selectivity), as one expression."""
    return node_count.cast("double") * fanout.cast("double") * depth.cast("double") * (F.lit(1.0) - selectivity.cast("double"))


class PlanCache:
    """Plans by query and graph fingerprint: an entry never outlives the graph that it was made for."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], DataFrame] = {}

    @staticmethod
    def key(query: dict) -> str:
        return hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()

    def get(self, query: dict, graph_hash: str) -> DataFrame | None:
        return self._held.get((self.key(query), graph_hash))

    def put(self, query: dict, graph_hash: str, plan: DataFrame) -> DataFrame:
        return self._held.setdefault((self.key(query), graph_hash), plan)

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)
