"""One configuration object. Unknown keys raise; a file that is named must exist and parse."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from pyspark.sql import SparkSession


class ConfigError(ValueError):
    pass


@dataclass
class IoConfig:
    #: "auto", "hot" or "cold": how many bytes of files a scan task takes at once (Spark does the reading).
    mode: str = "auto"
    uring_enabled: bool = False

    def partition_bytes(self) -> int:
        return {"auto": 128 << 20, "hot": 128 << 20, "cold": 512 << 20}[self.mode]


@dataclass
class SnapshotConfig:
    path: str = "./snapshots"
    auto_save: bool = True


@dataclass
class ExecutionConfig:
    parallel: bool = True
    #: Shuffle partitions; 0 leaves the session's setting.
    thread_count: int = 0


@dataclass
class AnalysisConfig:
    max_taint_depth: int = 50
    max_points_to: int = 100
    max_rounds: int = 100
    max_hops: int = 100
    opaque_else: bool = False
    precise_cfg: bool = False
    linked: bool = True


@dataclass
class Config:
    io: IoConfig = field(default_factory=IoConfig)
    snapshot: SnapshotConfig = field(default_factory=SnapshotConfig)
    execution: ExecutionConfig = field(default_factory=ExecutionConfig)
    analysis: AnalysisConfig = field(default_factory=AnalysisConfig)

    @classmethod
    def load(cls, path: str | None = None, default: str = "weftgraph.toml") -> Config:
        """The named file, else ``default`` in the working folder if there, else the defaults."""
        chosen = Path(path or default)
        if not chosen.exists():
            if path:
                raise ConfigError(f"no such file: {path}")
            return cls()
        try:
            return _fill(cls, tomllib.loads(chosen.read_text()), "")
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{chosen}: {e}") from e

    def apply(self, spark: SparkSession) -> SparkSession:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(self.io.partition_bytes()))
        if self.execution.thread_count:
            spark.conf.set("spark.sql.shuffle.partitions", str(self.execution.thread_count))
        return spark


def _fill(kind, values: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    out = kind()
    for k, v in values.items():
        if k not in known:
            raise ConfigError(f"unknown key {where}{k}")
        now = getattr(out, k)
        if is_dataclass(now):
            if not isinstance(v, dict):
                raise ConfigError(f"{where}{k} is a table")
            v = _fill(type(now), v, f"{where}{k}.")
        elif type(v) is not type(now):
            raise ConfigError(f"{where}{k} is of type {type(now).__name__}")
        setattr(out, k, v)
    if isinstance(out, IoConfig) and out.mode not in ("auto", "hot", "cold"):
        raise ConfigError(f"{where}mode is auto, hot or cold")
    return out
