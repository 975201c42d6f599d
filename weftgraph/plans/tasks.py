"""Execution plans: fragments become lazy DataFrames, "parallel compute, serial commit" a sort key.

A plan is a list of stages, a stage a list of tasks. All tasks of a plan are one query for Catalyst; the
commit order survives as the columns (stage, commit, seq). Dependencies are checked, not scheduled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.model import InvariantError, PropertyGraph
from weftgraph.operators import primitives as P

IDS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", T.LongType())])


@dataclass(frozen=True)
class FindNodes:
    kind: str

    def run(self, g: PropertyGraph) -> DataFrame:
        return P.find_nodes(g.nodes, self.kind).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "id")


@dataclass(frozen=True)
class FollowEdges:
    starts: tuple[int, ...] | DataFrame
    kind: str

    def run(self, g: PropertyGraph) -> DataFrame:
        return P.follow_edges(_ids(g, self.starts), g.edges, self.kind).select(F.col("seq").alias("a"), F.col("edge_id").alias("b"), "id")


@dataclass(frozen=True)
class Filter:
    ids: tuple[int, ...] | DataFrame
    kind: str | None = None

    def run(self, g: PropertyGraph) -> DataFrame:
        return _plain(P.filter_ids(_ids(g, self.ids), g.nodes, self.kind))


@dataclass(frozen=True)
class Intersect:
    left: tuple[int, ...] | DataFrame
    right: tuple[int, ...] | DataFrame

    def run(self, g: PropertyGraph) -> DataFrame:
        return _plain(P.intersect(_ids(g, self.left), _ids(g, self.right)))


@dataclass(frozen=True)
class Reachable:
    starts: tuple[int, ...] | DataFrame
    hops: int

    def run(self, g: PropertyGraph) -> DataFrame:
        return P.reachable_within(g.edges, _ids(g, self.starts).select("id"), self.hops).select(F.col("depth").cast("long").alias("a"), F.col("id").alias("b"), "id")


Fragment = FindNodes | FollowEdges | Filter | Intersect | Reachable


def _ids(g: PropertyGraph, ids: tuple[int, ...] | DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids if "seq" in ids.columns else ids.withColumn("seq", F.col("id"))
    return g.nodes.sparkSession.createDataFrame(list(enumerate(ids)), IDS)


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.col("seq").alias("a"), F.lit(0).cast("long").alias("b"), "id")


@dataclass(frozen=True)
class Task:
    task_id: int
    fragment: Fragment
    slot: int
    depends_on: tuple[int, ...] = ()

    def is_ready(self, done: set[int]) -> bool:
        return set(self.depends_on) <= done


@dataclass
class Stage:
    """``by_task_id``: commit in the order of task ids, else in the order of insertion."""

    tasks: list[Task] = field(default_factory=list)
    by_task_id: bool = True

    def commit_order(self) -> list[Task]:
        return sorted(self.tasks, key=lambda t: t.task_id) if self.by_task_id else list(self.tasks)


@dataclass
class ExecutionPlan:
    stages: list[Stage] = field(default_factory=list)

    def add_stage(self, stage: Stage) -> ExecutionPlan:
        self.stages.append(stage)
        return self

    def task_count(self) -> int:
        return sum(len(s.tasks) for s in self.stages)

    def validate(self) -> None:
        """InvariantError for a repeated task or slot, an unknown dependency, one of a later stage, or a cycle."""
        home = {t.task_id: k for k, s in enumerate(self.stages) for t in s.tasks}
        if len(home) != self.task_count():
            raise InvariantError("two tasks have one id")
        for k, stage in enumerate(self.stages):
            slots = [t.slot for t in stage.tasks]
            if len(set(slots)) != len(slots):
                raise InvariantError("two tasks of a stage write one slot")
            for t in stage.tasks:
                if any(home.get(d, k + 1) > k for d in t.depends_on):
                    raise InvariantError(f"task {t.task_id} depends on a task that is missing or comes later")
        left = {t.task_id: t for s in self.stages for t in s.tasks}
        done: set[int] = set()
        while left:
            ready = [i for i, t in left.items() if t.is_ready(done)]
            if not ready:
                raise InvariantError("dependencies form a cycle")
            done.update(ready)
            for i in ready:
                del left[i]

    def execute(self, graph: PropertyGraph) -> DataFrame:
        """(stage, commit, task_id, a, b, id): all results; sort by the first three, then a and b.

        ``a`` and ``b`` order the results of one task: position of the start and edge id, or the like.
        """
        self.validate()
        rows = [
            task.fragment.run(graph).select(F.lit(k).alias("stage"), F.lit(at).alias("commit"), F.lit(task.task_id).cast("long").alias("task_id"), "a", "b", "id")
            for k, stage in enumerate(self.stages)
            for at, task in enumerate(stage.commit_order())
        ]
        if not rows:
            return graph.nodes.sparkSession.createDataFrame([], "stage int, commit int, task_id long, a long, b long, id long")
        return reduce(DataFrame.unionByName, rows)
