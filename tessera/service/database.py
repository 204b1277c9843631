"""Named graph databases under one root: create, open, list, query, drop."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from tessera.operators.bgp import Matcher, candidates
from tessera.operators.graph import Graph
from tessera.operators.results import DISPLAY_CAP, Shown, show
from tessera.plans.planner import Chooser, VariableGraph, components
from tessera.plans.sparql import parse
from tessera.sources import fs, store
from tessera.sources.ntriples import InvalidTriples, read_triples, validate


NAME = r"[A-Za-z0-9][\w.-]*"


class DatabaseError(RuntimeError):
    """``status`` is what the HTTP interface answers."""

    def __init__(self, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.status = status


class Cancelled(DatabaseError):
    def __init__(self) -> None:
        super().__init__("cancelled", 409)


@dataclass
class Progress:
    status: str = "idle"  # idle, running, success, error, cancelled
    percent: int = 0
    step: str = ""
    database: str = ""
    error: str = ""
    rejected: int = 0  # lines that are no triple, beyond those that validation looks at

    def as_dict(self) -> dict:
        return dict(vars(self))


class GraphDatabase:
    """The databases under ``root``; one of them is active at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.active: str | None = None
        self.graph: Graph | None = None
        self.progress = Progress()
        self._lock, self._stop = threading.RLock(), threading.Event()

    def path(self, name: str) -> str:
        if not re.fullmatch(NAME, name):
            raise DatabaseError(f"bad database name {name!r}")
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        return fs.exists(self.spark, f"{self.path(name)}/counters")

    def names(self) -> list[str]:
        return [n for n in fs.folders(self.spark, self.root) if re.fullmatch(NAME, n) and self.exists(n)]

    @property
    def building(self) -> bool:
        return self.progress.status == "running"

    def create(self, name: str, file: str, load: bool = True) -> Progress:
        """Validate an N-Triples file, store it as a database, and open it. A half-made database
        is removed, whatever went wrong."""
        with self._lock:
            if self.building:
                raise DatabaseError("another database is being created", 409)
            if self.exists(name):
                raise DatabaseError(f"database {name!r} exists", 409)
            self._stop.clear()
            self.progress = Progress("running", 0, "validate", name)
        try:
            self._step("validate", 5)
            checked = validate(self.spark, file)
            if not checked.ok:
                raise InvalidTriples(checked.error)
            self._step("store", 20)
            seen = Observation()
            store.save(read_triples(self.spark, file, seen=seen), self.path(name))
            self._step("load", 90)
            if load:
                self.load(name)
            self.progress = Progress("success", 100, "done", name, rejected=seen.get["rejected"])
        except Exception as e:
            fs.delete(self.spark, self.path(name))
            self.progress = Progress("cancelled" if isinstance(e, Cancelled) else "error", self.progress.percent, self.progress.step, name, str(e))
            raise
        return self.progress

    def _step(self, step: str, percent: int) -> None:
        if self._stop.is_set():
            raise Cancelled
        self.progress = Progress("running", percent, step, self.progress.database)

    def cancel(self) -> bool:
        """Stop a creation at its next step; whether there was one."""
        self._stop.set()
        return self.building

    def load(self, name: str) -> Graph:
        if not self.exists(name):
            raise DatabaseError(f"no database {name!r}", 404)
        with self._lock:
            self.graph, self.active = store.open_graph(self.spark, self.path(name)), name
            return self.graph

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise DatabaseError(f"no database {name!r}", 404)
        with self._lock:
            if self.active == name:
                self.graph, self.active = None, None
            fs.delete(self.spark, self.path(name))

    def stats(self, name: str | None = None) -> dict:
        name = name or self.active
        if name is None:
            raise DatabaseError("no active database")
        if not self.exists(name):
            raise DatabaseError(f"no database {name!r}", 404)
        return self.spark.read.parquet(f"{self.path(name)}/counters").first().asDict()

    def listing(self) -> list[dict]:
        return [{"name": n, "active": n == self.active, "stats": self.stats(n), "disk_bytes": fs.size(self.spark, self.path(n))} for n in self.names()]

    def opened(self, name: str | None = None) -> Graph:
        if name is not None and name != self.active:
            self.load(name)
        if self.graph is None:
            raise DatabaseError("no active database")
        return self.graph

    def query(self, text: str, name: str | None = None, **options) -> DataFrame:
        return Matcher(self.opened(name), **options).run(text)

    def answer(self, text: str, name: str | None = None, cap: int = DISPLAY_CAP, **options) -> Shown:
        began = time.perf_counter()
        shown = show(self.query(text, name, **options), cap)
        shown.elapsed_ms = 1000 * (time.perf_counter() - began)
        return shown

    def explain_graph(self, text: str, name: str | None = None) -> list[dict]:
        """The variable graph of each component of a query."""
        return [VariableGraph.of(m).as_dict() for m in components(candidates(self.opened(name), text))]


def query_file(path: str) -> list[str]:
    """One query per line."""
    with open(path, encoding="utf-8") as f:
        return [x.strip() for x in f if x.strip()]


def run_file(db: GraphDatabase, path: str, choose: Chooser | None = None, out: Callable[[str], None] = print) -> list[dict]:
    """Run each query of a file; its rows and times in ms, and the averages."""
    rows = []
    for i, text in enumerate(query_file(path), 1):
        began = time.perf_counter()
        df = Matcher(db.opened(), choose=choose).run(parse(text))
        planned = time.perf_counter()
        n = df.count()
        rows.append({"query": i, "rows": n, "plan_ms": 1000 * (planned - began), "execute_ms": 1000 * (time.perf_counter() - planned)})
        out(f"query {i}: {n} rows, plan {rows[-1]['plan_ms']:.1f} ms, execute {rows[-1]['execute_ms']:.1f} ms")
    if rows:
        out(f"average: plan {sum(r['plan_ms'] for r in rows) / len(rows):.1f} ms, execute {sum(r['execute_ms'] for r in rows) / len(rows):.1f} ms")
    return rows
