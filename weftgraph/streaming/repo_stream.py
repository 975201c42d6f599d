"""The incremental story as a stream: batches of file versions update a table of current files.

A file-source stream of file records runs the same diff as the batch engine in each micro-batch. The
state is the table of current files, written anew per batch under its batch id, so a batch that is run
again after a failure finds the state of the one before it and gives the same answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.changes import detect_changes
from weftgraph.sources.snapshot import Store

RECORD = "file_id string, content_hash string, version long, deleted boolean"


class RepoStream:
    """``changes(batch_id, df)`` gets (file_id, change) for every file that a batch names."""

    def __init__(self, spark: SparkSession, state_dir: str):
        self.spark, self.state_dir, self.store = spark, state_dir.rstrip("/"), Store(spark, state_dir)

    def _state(self, before: int) -> DataFrame:
        done = [int(x[6:]) for x in self.store.names() if x.startswith("batch-") and x[6:].isdigit() and int(x[6:]) < before]
        if not done:
            return self.spark.createDataFrame([], "file_id string, content_hash string")
        return self.spark.read.parquet(f"{self.state_dir}/batch-{max(done)}")

    def current(self) -> DataFrame:
        return self._state(2**62)

    def apply(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """(file_id, change) of the batch's files; unnamed files stay as they are. Late versions lose."""
        before = self._state(batch_id)
        last = W.partitionBy("file_id").orderBy(F.col("version").desc(), "content_hash")
        newest = batch.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n").cache()
        named = before.join(newest, "file_id", "left_semi")
        alive = newest.filter(~F.coalesce("deleted", F.lit(False))).select("file_id", "content_hash")
        diff = detect_changes(named, alive)
        after = before.join(newest, "file_id", "left_anti").unionByName(alive)
        after.write.mode("overwrite").parquet(f"{self.state_dir}/batch-{batch_id}")
        return diff

    def start(self, records: DataFrame, checkpoint: str, changes: Callable[[int, DataFrame], None], **trigger) -> StreamingQuery:
        """Runs over a streaming ``records`` table of the RECORD schema."""
        step = lambda df, batch_id: changes(batch_id, self.apply(df, batch_id))
        return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
