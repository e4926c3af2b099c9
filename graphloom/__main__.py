"""Command line: index, watch, serve and status of a workspace."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from graphloom import jsonrpc
from graphloom.jobs import Engine
from graphloom.operators.api import Budget, GraphApi
from graphloom.sources import git
from graphloom.sources.config import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--config", default="workspace.toml")
    p.add_argument("--home", default=".graphloom", help="folder of the graph and of what runs keep")
    p.add_argument("--repos", default="repos", help="folder of the clones")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="index what changed, then link")
    index.add_argument("--repo")
    index.add_argument("--full", action="store_true")
    watch = sub.add_parser("watch", help="index again and again")
    watch.add_argument("--interval", type=float, default=30.0, help="seconds between passes, at least 1")
    sub.add_parser("serve", help="answer questions, one message a line")
    sub.add_parser("status", help="what is indexed")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, Workspace.load(args.config), args.home)
    folder = lambda r: git.clone_or_open(r.github, f"{args.repos}/{r.id}")
    if args.command == "index":
        print(json.dumps(engine.index(folder, args.repo, args.full)))
    elif args.command == "watch":
        while True:
            began = time.monotonic()
            print(json.dumps(engine.index(folder)), flush=True)
            time.sleep(max(0.0, max(1.0, args.interval) - (time.monotonic() - began)))
    elif args.command == "serve":
        jsonrpc.serve(GraphApi(engine.store.nodes, engine.store.edges, Budget()))
    else:
        for row in engine.status().collect():  # configured branches
            print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
