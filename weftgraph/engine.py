"""The engine: source tree in, verified graph out, bounded queries over it."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import Config
from weftgraph.functions.durable import durable
from weftgraph.functions.hashing import graph_hash
from weftgraph.functions.metrics import MetricsCollector
from weftgraph.model import InvariantError, PropertyGraph
from weftgraph.operators import points_to, taint
from weftgraph.operators.changes import detect_changes, reparse_set
from weftgraph.operators.fusion import fuse
from weftgraph.operators.indices import Indices
from weftgraph.operators.paths import explain
from weftgraph.operators.primitives import graph_stats
from weftgraph.operators.semantic import SemanticEpoch
from weftgraph.plans.cost import PlanCache
from weftgraph.plans.json_query import compile_query
from weftgraph.sources import rust, snapshot
from weftgraph.sources.scan import RepoScanner, snapshot_hash


@dataclass
class Epoch:
    """One immutable generation: the files it saw and the graph made of them."""

    epoch_id: int
    files: DataFrame
    graph: PropertyGraph
    cpg_hash: str
    snapshot_hash: str
    facts: rust.Facts | None = None


@dataclass
class Engine:
    spark: SparkSession
    config: Config = field(default_factory=Config)
    metrics: MetricsCollector = field(default_factory=MetricsCollector)
    plans: PlanCache = field(default_factory=PlanCache)
    epochs: dict[int, Epoch] = field(default_factory=dict)
    results: dict[int, tuple[int, dict, DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.config.apply(self.spark)
        self._epoch, self._result = itertools.count(1), itertools.count(1)

    # repositories
    def load_repo(self, path: str, extensions: tuple[str, ...] = ("rs",)) -> Epoch:
        """Scans, parses and fuses a folder or file."""
        return self._build(RepoScanner(self.spark, path, extensions).contents(), None)

    def update_files(self, epoch: Epoch, path: str, extensions: tuple[str, ...] = ("rs",)) -> tuple[Epoch, DataFrame]:
        """(next epoch, its changes): only files that were added or modified are parsed again."""
        contents = RepoScanner(self.spark, path, extensions).contents()
        changes = durable(detect_changes(epoch.files, contents.select("file_id", "content_hash")))
        return self._build(contents, epoch), changes

    def _parse(self, files: DataFrame) -> rust.Facts:
        return rust.analyze(files, self.config.analysis.opaque_else, self.config.analysis.precise_cfg)

    def _build(self, contents: DataFrame, before: Epoch | None) -> Epoch:
        files = durable(contents.drop("content"))
        todo = contents.select("file_id", "content")
        if before is None or before.facts is None:
            facts = self._parse(todo)
        else:
            fresh = durable(reparse_set(before.files, files))
            new = self._parse(todo.join(fresh, "file_id", "left_semi"))
            keep = files.select("file_id").join(fresh, "file_id", "left_anti")
            both = lambda t: getattr(before.facts, t).join(keep, "file_id", "left_semi").unionByName(getattr(new, t))
            facts = rust.Facts(files.select("file_id"), *(both(t) for t in rust.TABLES))
            self.metrics.record_reparsed(fresh.count())
        number = next(self._epoch)
        graph = fuse(facts, linked=self.config.analysis.linked, epoch_id=number).checked(self.config.analysis.linked)
        epoch = Epoch(number, files, graph, graph_hash(graph.nodes, graph.edges), snapshot_hash(files), facts)
        self.epochs[number] = epoch
        return epoch

    # queries
    def run_query(self, epoch: Epoch, query: str | dict) -> int:
        """A result id; the plan is cached by query and graph fingerprint."""
        q = json.loads(query) if isinstance(query, str) else query
        plan = self.plans.get(q, epoch.cpg_hash)
        if plan is None:
            plan = self.plans.put(q, epoch.cpg_hash, compile_query(epoch.graph, q))
        number = next(self._result)
        self.results[number] = (epoch.epoch_id, q, plan)
        return number

    def fetch_result(self, result_id: int) -> DataFrame:
        """(seq, id); sort by ``seq`` for the engine's order."""
        return self.results[result_id][2]

    def explain_result(self, result_id: int, start: int) -> DataFrame:
        """(node, depth, edge_path, node_path, origin): how ``start`` leads to each result, and where it is from."""
        epoch_id, _, plan = self.results[result_id]
        graph = self.epochs[epoch_id].graph
        found = explain(graph.edges, start, plan.select("id").distinct(), self.config.analysis.max_hops)
        return found.join(graph.nodes.select(F.col("id").alias("node"), "kind", "origin", "label"), "node")

    # analyses
    def indices(self, epoch: Epoch) -> Indices:
        return Indices.build(epoch.graph.nodes, epoch.graph.edges)

    def taint(self, epoch: Epoch, sources: DataFrame, sinks: DataFrame) -> taint.TaintResult:
        return taint.analyze(epoch.graph.edges, sources, sinks, max_depth=self.config.analysis.max_taint_depth)

    def points_to(self, epoch: Epoch, seed: str = "self") -> points_to.PointsTo:
        values = epoch.graph.nodes.filter("kind = 'DfgValue'").select(F.col("id").alias("value"))
        flow = epoch.graph.edges.filter("kind = 'DataFlow'")
        return points_to.analyze(values, flow, seed, max_set=self.config.analysis.max_points_to, max_rounds=self.config.analysis.max_rounds)

    def stats(self, epoch: Epoch) -> DataFrame:
        return graph_stats(epoch.graph.nodes)

    def semantic(self, epoch: Epoch) -> SemanticEpoch:
        """The tables behind the graph: control flow, data flow, symbols, and what a change invalidates."""
        if epoch.facts is None:
            raise InvariantError("a loaded snapshot has no syntax tables")
        return SemanticEpoch.build(epoch.facts, epoch.epoch_id)

    # snapshots
    def snapshot_save(self, epoch: Epoch, root: str | None = None) -> tuple[int, str]:
        return snapshot.save(epoch.graph, root or self.config.snapshot.path)

    def snapshot_load(self, path: str) -> Epoch:
        graph, m = snapshot.load(self.spark, path)
        number = next(self._epoch)
        epoch = Epoch(number, self.spark.createDataFrame([], "file_id string, content_hash string"), graph, m.cpg_hash, "")
        self.epochs[number] = epoch
        return epoch

    def snapshot_verify(self, path: str) -> snapshot.Manifest:
        return snapshot.verify(self.spark, path)
