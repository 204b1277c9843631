"""A graph as one edge DataFrame per predicate, its access paths and its statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.kinds import TERM, Kind
from tessera.sources.fs import written

T = TypeVar("T")


@dataclass(frozen=True)
class Sizes:
    """Number of edges, different subjects and different objects, and of predicates that these
    are edges of; exact or estimated."""

    edges: float
    subjects: float
    objects: float
    predicates: float = 1.0

    @staticmethod
    def total(sizes: Iterable[Sizes]) -> Sizes:
        """Of several predicates together; ends count as often as predicates have them."""
        own = list(sizes)
        return Sizes(*(float(sum(x)) for x in zip(*((n.edges, n.subjects, n.objects, n.predicates) for n in own), strict=True))) if own else Sizes(0.0, 0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Star:
    """Where edges are columns of one table that has each subject once: patterns around a subject
    then need one scan, not a join for each. ``table`` tells tables apart."""

    table: str
    base: Callable[[], DataFrame]
    s: str
    o: str


@dataclass(frozen=True)
class Edges:
    """The edges of a predicate between two kinds of nodes: a set of (s, o) keys. The DataFrame
    and the sizes are made when asked for, so unused predicates cost nothing. Without a
    ``predicate``, these are the edges of all, and a column p tells which."""

    predicate: str | None
    s_kind: Kind
    o_kind: Kind
    make: Callable[[], DataFrame]
    measure: Callable[[], Sizes]
    star: Star | None = None

    @property
    def df(self) -> DataFrame:
        return self.make()

    @property
    def sizes(self) -> Sizes:
        return self.measure()


class Graph:
    def __init__(self, spark: SparkSession, edges: Iterable[Edges]) -> None:
        self.spark = spark
        self.by_predicate: dict[str, list[Edges]] = {}
        for e in edges:
            self.by_predicate.setdefault(e.predicate, []).append(e)

    @staticmethod
    def of_triples(triples: DataFrame, sizes: dict[str, Sizes] | None = None, predicates: list[str] | None = None) -> Graph:
        """A graph over a DataFrame (s, p, o) of terms, which must be a set. Predicates are
        gathered (one row each) unless given."""
        if predicates is None:
            predicates = [r["p"] for r in triples.select("p").distinct().collect()]

        def measured() -> dict[str, Sizes]:
            if sizes is not None:
                return sizes
            per = triples.groupBy("p").agg(F.count("*"), F.approx_count_distinct("s"), F.approx_count_distinct("o"))
            return {p: Sizes(*n) for p, *n in per.collect()}  # one row per predicate

        known = _once(measured)

        def edges(p: str) -> Edges:
            return Edges(p, TERM, TERM, lambda: triples.filter(F.col("p") == p).select("s", "o"), lambda: known().get(p, Sizes(0, 0, 0)))

        graph = Graph(triples.sparkSession, [edges(p) for p in predicates])
        graph._triples = triples.select("s", "p", "o")
        return graph

    _triples: DataFrame | None = None

    def whole(self) -> Edges | None:
        """The edges of all predicates as one set, where one scan gives them; None for graphs
        whose predicates lie in tables of their own."""
        if self._triples is None:
            return None
        every = [e for es in self.by_predicate.values() for e in es]
        return Edges(None, TERM, TERM, self.triples, _once(lambda: Sizes.total(e.sizes for e in every)))

    def edges(self, predicate: str) -> list[Edges]:
        return self.by_predicate.get(predicate, [])

    def triples(self, predicates: Iterable[str] | None = None, s: str | None = None, o: str | None = None) -> DataFrame:
        """(s, p, o) as terms. Constants become filters on keys inside each branch, and branches
        that cannot hold them are left out."""
        if self._triples is not None:
            out = self._triples
            if predicates is not None:
                out = out.filter(F.col("p").isin(*predicates))
            for name, term in (("s", s), ("o", o)):
                out = out if term is None else out.filter(F.col(name) == term)
            return out
        branches = None
        for p in sorted(self.by_predicate) if predicates is None else [p for p in predicates if p in self.by_predicate]:
            for e in self.by_predicate[p]:
                keys = {n: k.key(t) for n, k, t in (("s", e.s_kind, s), ("o", e.o_kind, o)) if t is not None}
                if None in keys.values():
                    continue
                df = e.df
                for name, key in keys.items():
                    df = df.filter(F.col(name) == F.lit(key))
                df = df.select(e.s_kind.render(F.col("s")).alias("s"), F.lit(p).alias("p"), e.o_kind.render(F.col("o")).alias("o"))
                branches = df if branches is None else branches.unionByName(df)
        return branches if branches is not None else self.spark.createDataFrame([], "s string, p string, o string")

    # Access paths: each is a set.

    def subjects(self, p: str) -> DataFrame:
        return self.triples([p]).select("s").distinct()

    def objects(self, p: str) -> DataFrame:
        return self.triples([p]).select("o").distinct()

    def predicates_of_subject(self, s: str) -> DataFrame:
        return self.triples(s=s).select("p").distinct()

    def predicates_of_object(self, o: str) -> DataFrame:
        return self.triples(o=o).select("p").distinct()

    def objects_of(self, s: str, p: str) -> DataFrame:
        return self.triples([p], s=s).select("o")

    def subjects_of(self, o: str, p: str) -> DataFrame:
        return self.triples([p], o=o).select("s")

    def predicates_between(self, s: str, o: str) -> DataFrame:
        return self.triples(s=s, o=o).select("p")

    def all_objects(self, s: str) -> DataFrame:
        return self.triples(s=s).select("o").distinct()

    def all_subjects(self, o: str) -> DataFrame:
        return self.triples(o=o).select("s").distinct()

    # Statistics.

    def predicate_stats(self) -> DataFrame:
        """p, edges, subjects, objects: exact. Distinct ends are pre-aggregated, so predicates
        with many edges do not meet in one task."""
        t = self.triples()
        ends = lambda c, *of: t.groupBy("p", c).agg(F.count("*").alias("n")).groupBy("p").agg(*of)
        subjects = ends("s", F.sum("n").alias("edges"), F.count("*").alias("subjects"))
        return subjects.join(ends("o", F.count("*").alias("objects")), "p").select("p", "edges", "subjects", "objects")

    def degrees(self, end: str = "s") -> DataFrame:
        """Number of triples of each subject (``s``) or object (``o``)."""
        return self.triples().groupBy(F.col(end).alias("term")).agg(F.count("*").alias("degree"))

    def roles(self) -> DataFrame:
        """(term, role): ``shared`` for terms that are subjects and objects, else ``subject`` or
        ``object``."""
        t = self.triples()
        ends = t.select(F.col("s").alias("term"), F.lit(1).alias("bit")).union(t.select(F.col("o").alias("term"), F.lit(2).alias("bit")))
        bits = ends.groupBy("term").agg(F.bit_or("bit").alias("bits"))
        return bits.select("term", F.when(F.col("bits") == 3, "shared").when(F.col("bits") == 1, "subject").otherwise("object").alias("role"))

    def database_stats(self) -> DataFrame:
        """One row: subject_count and object_count (of terms in that role only), shared_count,
        entity_count, predicate_count, triple_count."""
        n = lambda role: F.count(F.when(F.col("role") == role, 1)).alias(f"{role}_count")
        terms = self.roles().agg(n("subject"), n("object"), n("shared"), F.count("*").alias("entity_count"))
        per = self.triples().groupBy("p").agg(F.count("*").alias("n")).agg(F.count("*").alias("predicate_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("triple_count"))
        return terms.crossJoin(per)

    def characteristic_sets(self, end: str = "s") -> DataFrame:
        """(predicates, entities): each set of predicates that some subject (or object) has, as
        sorted array, with the number of those that have exactly it."""
        sets = self.triples().select(end, "p").distinct().groupBy(end).agg(F.sort_array(F.collect_set("p")).alias("predicates"))
        return sets.groupBy("predicates").agg(F.count("*").alias("entities"))

    def characteristic_set_of(self, entity: str, end: str = "s") -> DataFrame:
        own = self.triples(**{end: entity})
        return own.agg(F.sort_array(F.collect_set("p")).alias("predicates")).filter("size(predicates) > 0")

    def with_predicates(self, predicates: list[str], end: str = "s") -> DataFrame:
        """The characteristic set that is exactly ``predicates``, if any entity has it."""
        want = F.array(*(F.lit(p) for p in sorted(set(predicates))))
        return self.characteristic_sets(end).filter(F.col("predicates") == want)

    def dictionary(self) -> DataFrame:
        """(term, role, id): ids from 1, shared terms first, then subjects, then objects, each in
        the order of their text. Terms are sorted in ranges, written with their place in the range
        (read twice, places must not differ), and ranges begin where those before them end."""
        order = F.when(F.col("role") == "shared", 0).when(F.col("role") == "subject", 1).otherwise(2)
        ranked = self.roles().select("term", "role", order.alias("rank")).orderBy("rank", "term")
        # the upper 31 bits are the number of the range, the lower 33 the place in it
        placed = written(ranked.select("term", "role", F.monotonically_increasing_id().alias("at")), "dictionary")
        placed = placed.select("term", "role", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
        # one row per range
        starts = placed.groupBy("range").agg(F.count("*").alias("held"))
        starts = starts.select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        return placed.join(starts, "range").select("term", "role", (F.col("start") + F.col("place") + 1).alias("id"))


def _once(f: Callable[[], T]) -> Callable[[], T]:
    have: list[T] = []

    def of() -> T:
        if not have:
            have.append(f())
        return have[0]

    return of
