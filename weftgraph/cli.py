"""Command line: one JSON line per command on stdout; any failure is JSON on stderr and exit code 1."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weftgraph.config import Config
from weftgraph.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("path")
    snap = sub.add_parser("snapshot").add_subparsers(dest="action", required=True)
    save = snap.add_parser("save")
    save.add_argument("path", help="source tree")
    save.add_argument("--to", default=None)
    for name in ("load", "verify"):
        snap.add_parser(name).add_argument("path")
    q = sub.add_parser("query")
    q.add_argument("file")
    q.add_argument("--snapshot", required=True)
    e = sub.add_parser("explain")
    e.add_argument("result_id", type=int, help="node id")
    e.add_argument("--snapshot", required=True)
    e.add_argument("--from", dest="start", type=int, required=True)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    engine = Engine(spark, Config.load(args.config))
    if args.command == "ingest":
        epoch = engine.load_repo(args.path)
        return {"status": "success", "epoch_id": epoch.epoch_id, "cpg_hash": epoch.cpg_hash, "nodes": epoch.graph.nodes.count()}
    if args.command == "snapshot":
        if args.action == "save":
            number, digest = engine.snapshot_save(engine.load_repo(args.path), args.to)
            return {"status": "success", "snapshot_id": number, "hash": digest}
        m = engine.snapshot_verify(args.path)
        return {"status": "success", "hash": m.cpg_hash, {"load": "verified", "verify": "valid"}[args.action]: True}
    if args.command == "query":
        text = Path(args.file).read_text()
        epoch = engine.snapshot_load(args.snapshot)
        rows = [r["id"] for r in engine.fetch_result(engine.run_query(epoch, text)).orderBy("seq").select("id").toLocalIterator()]
        return {"status": "success", "query": args.file, "results": rows, "count": len(rows)}
    epoch = engine.snapshot_load(args.snapshot)
    result = engine.run_query(epoch, {"op": "filter", "ids": [args.result_id]})
    rows = engine.explain_result(result, args.start).collect()  # one node, one row at most
    trace = [f"node {n}" for r in rows for n in r["node_path"]]
    return {"status": "success", "result_id": str(args.result_id), "provenance": trace}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        print(json.dumps(run(args, spark or SparkSession.builder.appName("weftgraph").getOrCreate())))
        return 0
    except SystemExit:
        raise
    except Exception as e:  # the contract: every failure is fatal and reported the same way
        print(json.dumps({"status": "error", "message": str(e).splitlines()[0] if str(e) else type(e).__name__, "fatal": True}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())


