"""Command line: build, query, train, test, server.

    python -m tessera build  -d NAME -f FILE.nt
    python -m tessera query  -d NAME -f QUERIES    (one query per line)
    python -m tessera train  -d NAME -f QUERIES -m MODEL.json
    python -m tessera test   -d NAME -f QUERIES -m MODEL.json
    python -m tessera server [--host H] [--port P]

``-t`` is the number of threads where Spark runs in this process; a cluster has its own.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from tessera.operators.bgp import candidates
from tessera.plans.learned import LearnedOrder
from tessera.plans.planner import components
from tessera.service.database import GraphDatabase, query_file, run_file


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("build", "query", "train", "test", "server"))
    parser.add_argument("-d", "--database")
    parser.add_argument("-f", "--file")
    parser.add_argument("-m", "--model", default="order.json")
    parser.add_argument("-t", "--threads", type=int)
    parser.add_argument("--root", default="databases")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8080)
    a = parser.parse_args(args)
    if a.command != "server" and not (a.database and a.file):
        parser.error(f"{a.command} needs -d and -f")
    if spark is None:
        builder = SparkSession.builder.appName("tessera")
        spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    db = GraphDatabase(spark, a.root)
    if a.command == "server":
        from tessera.service.http import serve

        server = serve(db, os.path.join(a.root, ".uploads"), a.host, a.port)
        print(f"listening on http://{a.host}:{server.server_port}/ui")
        server.serve_forever()
        return 0
    if a.command == "build":
        print(db.create(a.database, a.file).as_dict())
        return 0
    graph = db.load(a.database)
    if a.command == "query":
        run_file(db, a.file)
    elif a.command == "train":
        learner = LearnedOrder()
        parts = [m for text in query_file(a.file) for m in components(candidates(graph, text)) if len(m) > 1]
        rewards = learner.train(parts) if parts else []
        learner.save(a.model)
        print(f"trained on {len(parts)} components" + (f", reward {rewards[0]:.3f} to {rewards[-1]:.3f}" if rewards else ""))
    else:
        run_file(db, a.file, choose=LearnedOrder.load(a.model))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
