"""A graph on disk: triples partitioned by predicate, statistics, and counters, all Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kinds import TERM
from tessera.operators.graph import Edges, Graph, Sizes

_SCHEMA = "s string, o string, p_id int"
#: Predicates that are broadcast at most; beyond, the join shuffles.
MOST_BROADCAST = 100_000


def _named(rows: DataFrame, predicates: DataFrame, n: int) -> DataFrame:
    ids = F.broadcast(predicates) if n <= MOST_BROADCAST else predicates
    return rows.join(ids, "p_id").select("s", "p", "o")


def save(triples: DataFrame, path: str) -> None:
    """Write a set of triples (s, p, o). Predicates get numbers in the order of their text; rows
    of a predicate are clustered by subject, so filters on it skip row groups."""
    spark = triples.sparkSession
    triples = triples.select("s", "p", "o")
    names = [r["p"] for r in triples.select("p").distinct().orderBy("p").collect()]
    predicates = spark.createDataFrame(list(enumerate(names)), "p_id int, p string")
    predicates.coalesce(1).write.mode("errorifexists").parquet(f"{path}/predicates")
    ids = F.broadcast(predicates) if len(names) <= MOST_BROADCAST else predicates
    rows = triples.join(ids, "p").select("s", "o", "p_id")
    rows.repartitionByRange("p_id", "s").sortWithinPartitions("p_id", "s", "o").write.partitionBy("p_id").parquet(f"{path}/triples")
    own = open_triples(spark, path)
    graph = Graph.of_triples(own, predicates=names)
    graph.predicate_stats().coalesce(1).write.parquet(f"{path}/stats")
    graph.database_stats().coalesce(1).write.parquet(f"{path}/counters")


def open_triples(spark: SparkSession, path: str) -> DataFrame:
    predicates = spark.read.parquet(f"{path}/predicates")
    rows = spark.read.schema(_SCHEMA).parquet(f"{path}/triples")
    return _named(rows, predicates, predicates.count())


def open_graph(spark: SparkSession, path: str) -> Graph:
    """The stored graph. A constant predicate reads its own partition only."""
    stats = {r["p"]: Sizes(r["edges"], r["subjects"], r["objects"]) for r in spark.read.parquet(f"{path}/stats").collect()}
    numbers = {r["p"]: r["p_id"] for r in spark.read.parquet(f"{path}/predicates").collect()}
    return StoredGraph(spark, path, numbers, stats)


class StoredGraph(Graph):
    def __init__(self, spark: SparkSession, path: str, numbers: dict[str, int], stats: dict[str, Sizes]) -> None:
        rows = spark.read.schema(_SCHEMA).parquet(f"{path}/triples")

        def edges(p: str) -> Edges:
            return Edges(p, TERM, TERM, lambda: rows.filter(F.col("p_id") == numbers[p]).select("s", "o"), lambda: stats[p])

        super().__init__(spark, [edges(p) for p in numbers])
        self.path, self._numbers, self._rows = path, numbers, rows

    def triples(self, predicates=None, s=None, o=None) -> DataFrame:
        """Many predicates are one scan, whose constants reach the files."""
        rows = self._rows
        if predicates is not None:
            rows = rows.filter(F.col("p_id").isin(*(self._numbers[p] for p in predicates if p in self._numbers)))
        for name, term in (("s", s), ("o", o)):
            rows = rows if term is None else rows.filter(F.col(name) == term)
        names = self.spark.read.parquet(f"{self.path}/predicates")
        return _named(rows, names, len(self._numbers))

    def whole(self) -> Edges:
        """A variable predicate is one scan, not one for each predicate."""
        return Edges(None, TERM, TERM, self.triples, lambda: Sizes.total(e.sizes for es in self.by_predicate.values() for e in es))

    def counters(self) -> dict[str, int]:
        return self.spark.read.parquet(f"{self.path}/counters").first().asDict()
