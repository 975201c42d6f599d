"""Repository scan: a folder becomes a table of files with stable ids and content hashes.

Executors read and hash; the driver sees no content. Paths are relative to the root, so ids and the
snapshot hash do not depend on where a repository lies.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.hashing import content_hash, file_id, snapshot_payload, stream

# Language by extension, and back.
LANGUAGES = {"rs": "Rust"}
#: SHA-256 of nothing: the snapshot of a repository without files.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


@dataclass
class RepoScanner:
    spark: SparkSession
    root: str
    extensions: tuple[str, ...] = ()
    follow_symlinks: bool = False
    _links: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            raise FileNotFoundError(self.root)
        self.uri = fs.resolvePath(p).toString().rstrip("/")
        self.single = fs.getFileStatus(p).isFile()
        local = self.uri.removeprefix("file:")
        if not self.follow_symlinks and self.uri.startswith("file:") and os.path.isdir(local):  # only a local store has links
            for top, folders, names in os.walk(local):
                self._links += [os.path.relpath(os.path.join(top, x), local) for x in (*folders, *names) if os.path.islink(os.path.join(top, x))]

    def with_extensions(self, *extensions: str) -> RepoScanner:
        return RepoScanner(self.spark, self.root, extensions, self.follow_symlinks)

    def contents(self) -> DataFrame:
        """(file_id, path, size, mtime, content_hash, language, content). Empty ``extensions`` takes all files."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        raw = reader.load(self.uri)
        base = self.uri.rpartition("/")[0] if self.single else self.uri
        full = F.regexp_replace("path", r"^([a-z]+:)/+", "$1/")
        path = F.substring(full, F.lit(len(_plain(base)) + 2), F.length(full))
        files = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
        if self.extensions:
            files = files.filter(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*self.extensions))
        for link in self._links:
            files = files.filter((F.col("path") != link) & ~F.col("path").startswith(f"{link}/"))
        return files.select(file_id(F.col("path")).alias("file_id"), "path", "size", "mtime", content_hash(F.col("content")).alias("content_hash"), language_of(F.col("path")).alias("language"), "content")

    def scan(self) -> DataFrame:
        """The files table, without content; sort by ``file_id`` (unsigned order) or ``path``."""
        return self.contents().drop("content")


def _plain(uri: str) -> str:
    head, sep, rest = uri.partition(":")
    return f"{head}:/{rest.lstrip('/')}" if sep else uri


def snapshot_hash(files: DataFrame) -> str:
    """SHA-256 over all files in the order of the unsigned id; times do not count.

    Blobs of rows are streamed in order: the hash is sequential, its memory is not the repository's. Many small
    snapshots at once are ``hashing.snapshot_hashes``.
    """
    digest = hashlib.sha256()
    stream(files, file_id(F.col("path")), snapshot_payload(F.col("path"), F.col("size"), F.col("content_hash")), digest)
    return digest.hexdigest()
