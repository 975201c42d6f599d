"""Cutting lineage so that a job survives lost executors.

Everything written here goes to the folder that ``spark.checkpoint.dir`` names, which all executors
share. Only where that setting is absent on a local master (tests, a laptop) is a local folder used.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; set once if a local session names none. A cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty() and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftgraph-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, replicated by the shared store, freed with the plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SETTINGS = threading.RLock()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (dots as ``__``) for the eager steps within; steps that need their own take turns."""
    with _SETTINGS:
        named = {k.replace("__", "."): str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}
        before = {k: spark.conf.get(k) for k in named}
        try:
            for k, v in named.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)


def durable_by(df: DataFrame, *cols: str) -> DataFrame:
    """``durable``, dealt and sorted by ``cols``: later joins on them move only their other side.

    A plan that adapts does not say how its result is dealt, so this one is made without adaptation.
    """
    spark = df.sparkSession
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cols).sortWithinPartitions(*cols)
    with settings(spark, spark__sql__adaptive__enabled=False):
        return durable(dealt)


def small_batches(spark: SparkSession, rows: int = 512):
    """What is computed within hands Python at most ``rows`` rows at a time: whole texts, little memory."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows)


class Scratch:
    """Parquet tables in the shared folder, for data that later steps read by column or partition.

    ``drop()`` removes them as soon as nothing lazy refers to them; what is left goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
        self._count = 0

    def _path(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def store(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        p, fs = self._path(self.root)
        fs.deleteOnExit(p)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        p, fs = self._path(self.root)
        fs.delete(p, True)
