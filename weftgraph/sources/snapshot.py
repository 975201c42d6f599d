"""Verified snapshots: Parquet tables with a manifest that carries the graph's fingerprint.

A snapshot is written into a hidden folder and renamed when complete, so readers see all of it or
nothing. Loading recomputes the fingerprint and raises on any difference.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from weftgraph.functions.hashing import graph_hash
from weftgraph.model import SCHEMAS, PropertyGraph

VERSION = 1


class SnapshotError(RuntimeError):
    pass


@dataclass(frozen=True)
class Manifest:
    version: int
    epoch_id: int
    cpg_hash: str
    timestamp: int


class Store:
    """Small-file access in whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(f"{self.root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str | None:
        p = self.path(f"{self.root}/{name}")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        p = self.path(self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def move(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(f"{self.root}/{a}"), self.path(f"{self.root}/{b}")):
            raise SnapshotError(f"{b} cannot be created in {self.root}")

    def claim(self, name: str) -> bool:
        """Creates an empty file; false if it is there already. Of several callers one is told true."""
        p = self.path(f"{self.root}/{name}")
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local store looks first and creates then; the system call is exclusive
            own = self.spark._jvm.java.io.File(p.toUri().getPath())
            own.getParentFile().mkdirs()
            return own.createNewFile()
        try:
            self.fs.create(p, False).close()
            return True
        except Py4JJavaError as e:  # stores differ in the class: ours, or a general one for a file that is there
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException" or self.fs.exists(p):
                return False
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def _number(name: str) -> int | None:
    return int(name[5:]) if name.startswith("snap-") and name[5:].isdigit() else None


def snapshot_ids(spark: SparkSession, root: str) -> list[int]:
    return sorted(n for x in Store(spark, root).names() if (n := _number(x)) is not None)


def save(graph: PropertyGraph, root: str) -> tuple[int, str]:
    """(snapshot id, fingerprint); ids count up from 1."""
    spark = graph.nodes.sparkSession
    store = Store(spark, root)
    hidden = f"_tmp-{uuid.uuid4().hex}"
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        df.write.parquet(f"{store.root}/{hidden}/{name}")
    written = _tables(spark, f"{store.root}/{hidden}", graph.epoch_id)
    digest = graph_hash(written.nodes, written.edges)
    store.write(f"{hidden}/manifest.json", json.dumps(asdict(Manifest(VERSION, graph.epoch_id, digest, int(time.time())))))
    new = max(snapshot_ids(spark, root), default=0) + 1
    while True:  # who holds a number's claim may create its folder; a claim left by a writer that failed keeps it unused
        if store.claim(f"_claim-{new}"):
            if f"snap-{new}" not in store.names():
                break
            store.remove(f"_claim-{new}")
        new += 1
    store.move(hidden, f"snap-{new}")
    store.remove(f"_claim-{new}")
    return new, digest


def _tables(spark: SparkSession, path: str, epoch_id: int) -> PropertyGraph:
    read = lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    return PropertyGraph(read("nodes"), read("edges"), epoch_id)


def manifest(spark: SparkSession, path: str) -> Manifest:
    text = Store(spark, path).read("manifest.json")
    if text is None:
        raise SnapshotError(f"no manifest in {path}")
    try:
        found = Manifest(**json.loads(text))
    except (ValueError, TypeError) as e:
        raise SnapshotError(f"unreadable manifest in {path}") from e
    if found.version != VERSION:
        raise SnapshotError(f"snapshot version {found.version}; this engine reads {VERSION}")
    return found


def verify(spark: SparkSession, path: str) -> Manifest:
    """The manifest, after the version and the recomputed fingerprint have been found right."""
    return load(spark, path)[1]


def load(spark: SparkSession, path: str) -> tuple[PropertyGraph, Manifest]:
    m = manifest(spark, path)
    graph = _tables(spark, path.rstrip("/"), m.epoch_id)
    if (found := graph_hash(graph.nodes, graph.edges)) != m.cpg_hash:
        raise SnapshotError(f"fingerprint is {found}, the manifest says {m.cpg_hash}")
    return graph, m
