"""Byte-exact SHA-256 fingerprints.

A stream of bytes is built as a hex string and hashed in one go (small graphs, one group a row), or built
in blobs of a batch of rows by the executors and streamed in order to an incremental hash on the driver
(whole graphs of any size): SHA-256 is sequential, but no row is handled there.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ordering import ordered_list
from weftgraph.model import EDGE_KINDS, NODE_KINDS, InvariantError, code_of


def be64(x: Column) -> Column:
    """16 hex digits, most significant byte first; negative values are two's complement."""
    return F.lower(F.lpad(F.hex(x.cast("long")), 16, "0"))


def le64(x: Column) -> Column:
    """16 hex digits, least significant byte first."""
    h = be64(x)
    return F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2)))


def u8(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))


def text_hex(x: Column) -> Column:
    return F.lower(F.hex(F.encode(x, "UTF-8")))


def sha256_of_hex(x: Column) -> Column:
    return F.sha2(F.unhex(x), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def file_id(path: Column) -> Column:
    """First 8 bytes of SHA-256 of the relative path, as hex: sorts like the unsigned number."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def snapshot_payload(path: Column, size: Column, digest: Column) -> Column:
    """Bytes (hex) that one file adds to its snapshot's stream."""
    return F.concat(be64_of_hex(file_id(path)), text_hex(path), be64(size), text_hex(digest))


def be64_of_hex(x: Column) -> Column:
    return F.lower(x)


def snapshot_hashes(files: DataFrame, *by: str) -> DataFrame:
    """``snapshot_hash`` per group of ``files(path, size, content_hash)``, in the order of the unsigned id.

    For many snapshots of a few million files each: a group's stream of some 200 bytes a file is one value, which
    Spark limits to 2 GB. One larger snapshot is streamed by ``scan.snapshot_hash``.
    """
    payload = ordered_list(file_id(F.col("path")), snapshot_payload(F.col("path"), F.col("size"), F.col("content_hash")))
    return files.groupBy(*by).agg(sha256_of_hex(F.array_join(payload, "")).alias("snapshot_hash"))


def node_bytes(kind_code: Column) -> Column:
    return F.concat(le64(F.col("id")), u8(kind_code), le64(F.col("range_start")), le64(F.col("range_end")))


def edge_bytes(kind_code: Column) -> Column:
    return F.concat(le64(F.col("id")), u8(kind_code), le64(F.col("src")), le64(F.col("dst")))


def stream(rows: DataFrame, order: Column, payload: Column, digest) -> None:
    """Feeds the bytes (hex) of all ``rows`` in the order of ``order`` to ``digest``.

    Rows are range-partitioned and sorted; executors put the bytes of a batch together, and the driver takes
    those blobs partition by partition. A row without bytes breaks an invariant.
    """

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(0).null_count:
                raise InvariantError("a row has no bytes: its kind is unknown or a column is null")
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(b.column(0).to_pylist())], pa.binary())], names=["b"])

    dealt = rows.select(order.alias("_o"), F.unhex(payload).alias("_b")).repartitionByRange("_o").sortWithinPartitions("_o")
    for (part,) in dealt.select("_b").mapInArrow(blobs, "b binary").toLocalIterator(prefetchPartitions=True):
        digest.update(part)


def graph_hash(nodes: DataFrame, edges: DataFrame) -> str:
    """SHA-256 over counts, nodes and edges in id order; memory is some blobs."""
    digest = hashlib.sha256()
    for rows, kinds, row in ((nodes, NODE_KINDS, node_bytes), (edges, EDGE_KINDS, edge_bytes)):
        digest.update(struct.pack("<Q", rows.count()))
        stream(rows, F.col("id"), row(code_of(F.col("kind"), kinds)), digest)
    return digest.hexdigest()


def cfg_hashes(nodes: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """``cfg_hash`` per function: function id, nodes (id, kind), edges (from, to, kind); no ranges, no text.

    ``by`` names the key columns, the last of them the function id.
    """
    return _flow_hashes(nodes, edges, F.col("node_id"), text_hex(F.col("kind")), "cfg_hash", by)


def dfg_hashes(values: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """``dfg_hash`` per function; a value's kind is printed with its payload, as ``Variable { name: "x" }``."""
    v = F.col("value")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    shown = (
        F.when(v["tag"] == "Variable", F.concat(F.lit("Variable { name: "), quoted(v["name"]), F.lit(" }")))
        .when(v["tag"] == "Constant", F.concat(F.lit("Constant { value: "), quoted(v["value"]), F.lit(" }")))
        .when(v["tag"] == "Parameter", F.concat(F.lit("Parameter { position: "), v["position"].cast("string"), F.lit(" }")))
        .otherwise(v["tag"])
    )
    return _flow_hashes(values, edges, F.col("value_id"), text_hex(shown), "dfg_hash", by)


def _flow_hashes(nodes: DataFrame, edges: DataFrame, node_id: Column, kind: Column, out: str, by: tuple[str, ...]) -> DataFrame:
    a = nodes.groupBy(*by).agg(F.array_join(ordered_list(node_id, F.concat(be64(node_id), kind)), "").alias("_nodes"))
    b = edges.groupBy(*by).agg(F.array_join(ordered_list(F.col("seq"), F.concat(be64(F.col("src")), be64(F.col("dst")), text_hex(F.col("kind")))), "").alias("_edges"))
    both = a.join(b, list(by), "full_outer")
    return both.select(*by, sha256_of_hex(F.concat(be64(F.col(by[-1])), F.coalesce("_nodes", F.lit("")), F.coalesce("_edges", F.lit("")))).alias(out))
