"""Graphs over relational tables: each predicate is a pair of columns of a table.

The definitions below serve both the DataFrame edges and, for tests, the SQL that spells the same
edges as terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.kinds import INTEGER, TEXT, Kind, iri
from tessera.operators.graph import Edges, Graph, Sizes, Star

BASE = "http://example.org/"
ORDER, CUSTOMER, NATION, SUPPLIER, REGION, PART, USER, DOC = (iri(n, BASE) for n in ("order", "customer", "nation", "supplier", "region", "part", "user", "doc"))
TURN = iri("turn", BASE, integer=False)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def predicate(name: str) -> str:
    return f"<{BASE}p/{name}>"


@dataclass(frozen=True)
class Column:
    """Edges from two columns of a table; ``key``: the subject is unique there, so no two edges
    are equal. ``ends``: tables whose number of rows bounds subjects and objects, or numbers."""

    name: str
    table: str
    s: str
    s_kind: Kind
    o: str
    o_kind: Kind
    key: bool = True
    ends: tuple[str | float, str | float] = (1.0, 1.0)


COMMERCE = (
    Column("placedBy", "orders", "o_orderkey", ORDER, "o_custkey", CUSTOMER, ends=("orders", "customer")),
    Column("status", "orders", "o_orderkey", ORDER, "o_orderstatus", TEXT, ends=("orders", 3)),
    Column("priority", "orders", "o_orderkey", ORDER, "o_orderpriority", TEXT, ends=("orders", 5)),
    Column("inNation", "customer", "c_custkey", CUSTOMER, "c_nationkey", NATION, ends=("customer", "nation")),
    Column("segment", "customer", "c_custkey", CUSTOMER, "c_mktsegment", TEXT, ends=("customer", 5)),
    Column("suppNation", "supplier", "s_suppkey", SUPPLIER, "s_nationkey", NATION, ends=("supplier", "nation")),
    Column("inRegion", "nation", "n_nationkey", NATION, "n_regionkey", REGION, ends=("nation", "region")),
    Column("hasPart", "lineitem", "l_orderkey", ORDER, "l_partkey", PART, key=False, ends=("orders", "part")),
    Column("fulfilledBy", "lineitem", "l_orderkey", ORDER, "l_suppkey", SUPPLIER, key=False, ends=("orders", "supplier")),
    Column("suppliedBy", "lineitem", "l_partkey", PART, "l_suppkey", SUPPLIER, key=False, ends=("part", "supplier")),
    Column("label", "nation", "n_nationkey", NATION, "n_name", TEXT, ends=("nation", "nation")),
    Column("label", "region", "r_regionkey", REGION, "r_name", TEXT, ends=("region", "region")),
    Column("label", "customer", "c_custkey", CUSTOMER, "c_name", TEXT, ends=("customer", "customer")),
    Column("label", "supplier", "s_suppkey", SUPPLIER, "s_name", TEXT, ends=("supplier", "supplier")),
    Column("label", "part", "p_partkey", PART, "p_name", TEXT, ends=("part", 64)),
    Column("brand", "part", "p_partkey", PART, "p_brand", TEXT, ends=("part", 25)),
    Column("ptype", "part", "p_partkey", PART, "p_type", TEXT, ends=("part", 6)),
    Column("size", "part", "p_partkey", PART, "p_size", INTEGER, ends=("part", 50)),
)
DOCUMENTS = (
    Column("lang", "documents", "doc_id", DOC, "lang", TEXT, ends=("documents", 4)),
    Column("source", "documents", "doc_id", DOC, "source", TEXT, ends=("documents", 20)),
    Column("quality", "labels", "doc_id", DOC, "quality", INTEGER, ends=("labels", 2)),
    Column("toxic", "labels", "doc_id", DOC, "toxic", INTEGER, ends=("labels", 2)),
    Column("role", "conversations", "concat(conv_id, '/', turn)", TURN, "role", TEXT, ends=("conversations", 2)),
)

_READ: dict[tuple[str, str], DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (f"{spark.sparkContext.applicationId}|{sf_dir}", name)
    if key not in _READ:  # the schema is read once
        _READ[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _READ[key]


@lru_cache(maxsize=256)
def _rows(app: str, sf_dir: str, name: str) -> float:
    """Rows of a table, from Parquet footers: no column is read."""
    return float(_table(SparkSession.getActiveSession(), sf_dir, name).count())


def rows(spark: SparkSession, sf_dir: str, name: str) -> float:
    return _rows(spark.sparkContext.applicationId, sf_dir, name)


def _column_edges(spark: SparkSession, sf_dir: str, c: Column) -> Edges:
    def make() -> DataFrame:
        df = _table(spark, sf_dir, c.table).select(F.expr(c.s).alias("s"), F.expr(c.o).alias("o")).filter("s IS NOT NULL AND o IS NOT NULL")
        return df if c.key else df.distinct()

    def measure() -> Sizes:
        n = rows(spark, sf_dir, c.table)
        ends = [rows(spark, sf_dir, e) if isinstance(e, str) else float(e) for e in c.ends]
        return Sizes(n, min(n, ends[0]), min(n, ends[1]))

    star = Star(f"{sf_dir}/{c.table}", lambda: _table(spark, sf_dir, c.table), c.s, c.o) if c.key else None
    return Edges(predicate(c.name), c.s_kind, c.o_kind, make, measure, star)


def following(events: DataFrame, event_type: str) -> DataFrame:
    """(s, o): the users of two events of a type that follow each other in time. Minutes are
    windows of their own, and the last event of a minute is followed by the first of the next one
    that has any, in its day or else in the next day: a task needs the events of a minute, the
    minutes of a day, or one row per day."""
    own = events.filter(F.col("event_type") == event_type).select("ts", "event_id", "user_id", F.date_trunc("minute", "ts").alias("minute"))
    # structs, as the next event may be one without a user
    nxt = lambda c, w: F.lead(F.struct(F.col(c).alias("u"))).over(w)
    firsts = own.groupBy("minute").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("first")).withColumn("day", F.to_date("minute"))
    days = firsts.groupBy("day").agg(F.min("first").alias("first")).select("day", nxt("first.user_id", Window.orderBy("day")).alias("tomorrow"))
    in_day = firsts.select("minute", "day", nxt("first.user_id", Window.partitionBy("day").orderBy("minute")).alias("later"))
    after = in_day.join(days, "day").select("minute", F.coalesce("later", "tomorrow").alias("after"))
    in_minute = Window.partitionBy("minute").orderBy("ts", "event_id")
    pairs = own.select("minute", F.col("user_id").alias("s"), nxt("user_id", in_minute).alias("o")).join(after, "minute")
    return pairs.select("s", F.coalesce("o", "after").getField("u").alias("o")).filter("s IS NOT NULL AND o IS NOT NULL").distinct()


def _event_edges(spark: SparkSession, sf_dir: str, event_type: str) -> Edges:
    def measure() -> Sizes:
        n = rows(spark, sf_dir, "events")
        return Sizes(n / 5, n / 25, n / 25)

    return Edges(predicate(f"next_{event_type}"), USER, USER, lambda: following(_table(spark, sf_dir, "events"), event_type), measure)


def _turns(spark: SparkSession, sf_dir: str) -> Edges:
    def make() -> DataFrame:
        c = _table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
        after = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
        name = lambda t: F.concat(F.col("conv_id"), F.lit("/"), t)
        return c.join(after, ["conv_id", "turn"]).select(name(F.col("turn")).alias("s"), name(F.col("turn") + 1).alias("o"))

    def measure() -> Sizes:
        n = rows(spark, sf_dir, "conversations")
        return Sizes(n, n, n)

    return Edges(predicate("nextTurn"), TURN, TURN, make, measure)


def commerce_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(spark, [_column_edges(spark, sf_dir, c) for c in COMMERCE])


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(spark, [_event_edges(spark, sf_dir, t) for t in EVENT_TYPES])


def document_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(spark, [*(_column_edges(spark, sf_dir, c) for c in DOCUMENTS), _turns(spark, sf_dir)])


def full_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The commerce and the event graph together."""
    return Graph(spark, [*(_column_edges(spark, sf_dir, c) for c in COMMERCE), *(_event_edges(spark, sf_dir, t) for t in EVENT_TYPES)])


def _sql_term(column: str, kind: Kind) -> str:
    return f"'{kind.prefix}' || {column} || '{kind.suffix}'"


def edge_sql(which: Callable[[str], bool] | None = None) -> dict[str, str]:
    """Per predicate, SQL for its edges (s, o) as terms: what tests hold the edges against."""
    out: dict[str, list[str]] = {}
    for c in (*COMMERCE, *DOCUMENTS):
        out.setdefault(predicate(c.name), []).append(f"SELECT DISTINCT {_sql_term(c.s, c.s_kind)} AS s, {_sql_term(c.o, c.o_kind)} AS o FROM {c.table} WHERE {c.s} IS NOT NULL AND {c.o} IS NOT NULL")
    for t in EVENT_TYPES:
        out[predicate(f"next_{t}")] = [f"SELECT DISTINCT {_sql_term('user_id', USER)} AS s, {_sql_term('nxt', USER)} AS o FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = '{t}') WHERE nxt IS NOT NULL AND user_id IS NOT NULL"]
    a, b = "a.conv_id || '/' || a.turn", "b.conv_id || '/' || b.turn"
    out[predicate("nextTurn")] = [f"SELECT DISTINCT {_sql_term(a, TURN)} AS s, {_sql_term(b, TURN)} AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"]
    return {p: " UNION ".join(x) for p, x in out.items() if which is None or which(p)}
