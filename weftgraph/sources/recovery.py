"""Crash recovery of a snapshot folder: markers, partial writes, last valid snapshot."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weftgraph.sources.snapshot import SnapshotError, Store, manifest, snapshot_ids, verify

# The states of a folder.
CLEAN, PARTIAL, CORRUPTED = "Clean", "PartialEpoch", "Corrupted"


class RecoveryManager:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def mark_start(self, operation: str) -> None:
        """Idempotent: an operation that is marked and not completed shows as partial."""
        self.store.write(f"_started-{operation}", "")

    def mark_complete(self, operation: str) -> None:
        self.store.remove(f"_started-{operation}")

    def state(self) -> str:
        """Corrupted if a visible snapshot has no readable manifest, partial if a write did not end."""
        for n in snapshot_ids(self.spark, self.root):
            try:
                manifest(self.spark, f"{self.root}/snap-{n}")
            except SnapshotError:
                return CORRUPTED
        return PARTIAL if any(x.startswith(("_tmp-", "_started-")) for x in self.store.names()) else CLEAN

    def recover(self) -> int | None:
        """None if clean; after discarding partial writes the last valid snapshot's id; raises if corrupted."""
        now = self.state()
        if now == CLEAN:
            return None
        if now == CORRUPTED:
            raise SnapshotError(f"{self.root} is corrupted")
        for x in self.store.names():
            if x.startswith(("_tmp-", "_started-")):
                self.store.remove(x)
        return self.last_valid()

    def last_valid(self) -> int | None:
        for n in reversed(snapshot_ids(self.spark, self.root)):
            try:
                verify(self.spark, f"{self.root}/snap-{n}")
                return n
            except SnapshotError:
                continue
        return None
