"""Pattern matching: a query over a graph becomes one DataFrame.

Each pattern is a relation whose columns are variables; a component is a left-deep join of its
patterns in planned order, patterns that bind nothing new are semi-joins, components are
multiplied. Keys stay typed as long as all that meet are of one kind.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.kinds import INTEGER, TERM, TEXT, Kind
from tessera.operators.graph import Edges, Graph, Sizes
from tessera.operators.intersect import extend
from tessera.plans.planner import Candidate, Chooser, components, is_cycle, order_by_variables, planned, variable_order
from tessera.plans.sparql import Group, Number, Pattern, Query, Term, Test, Var, parse


#: A join that makes so many times the rows of either side multiplies them.
MULTIPLIES = 2
#: Rows of a side of such a join that is broadcast, and rows that a task of it is to make.
SMALL_SIDE, TASK_ROWS, MOST_TASKS = 100_000, 20_000_000, 2_000


@dataclass
class Relation:
    """Solutions: columns named ``v<number>``, the kind of each, and which may be unbound."""

    df: DataFrame
    kinds: dict[str, Kind]
    nullable: frozenset[str] = frozenset()

    def rendered(self, names: Iterable[str]) -> Relation:
        names = [n for n in names if self.kinds[n] != TERM]
        df = self.df
        for n in names:
            df = df.withColumn(n, self.kinds[n].render(F.col(n)))
        return Relation(df, self.kinds | dict.fromkeys(names, TERM), self.nullable)


@dataclass
class Access:
    """A pattern and the edge sets that can match it, with what is known of their sizes."""

    pattern: Pattern
    branches: list[Edges]
    rows: float
    values: dict[str, float]
    parts: list[Access] | None = None

    @property
    def names(self) -> tuple[str, ...]:
        own = [v for a in self.parts or [self] for v in a.pattern.variables]
        return tuple(dict.fromkeys(own))


class Matcher:
    """Turns a query into a DataFrame. ``strategy``: ``join``, or ``intersect``, which closes
    cycles by intersecting adjacency lists where no list is longer than ``max_degree``.
    ``choose`` is an order chooser (see ``planner.Chooser``)."""

    def __init__(self, graph: Graph, strategy: str = "join", choose: Chooser | None = None, max_degree: int = 10_000) -> None:
        if strategy not in ("join", "intersect"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.graph, self.strategy, self.choose, self.max_degree = graph, strategy, choose, max_degree
        self.spark = graph.spark
        self.names: dict[str, str] = {}

    def column(self, variable: str) -> str:
        """SPARQL names differ by case, Spark's do not: inside, variables have numbers."""
        return self.names.setdefault(variable, f"v{len(self.names)}")

    # Patterns ---------------------------------------------------------------------------------

    def accesses(self, patterns: list[Pattern]) -> list[Access]:
        """Edge sets of each pattern. Those whose kinds cannot meet the other patterns' are left
        out, again and again until nothing changes."""
        found = [(p, self._branches(p)) for p in dict.fromkeys(patterns)]
        changed = True
        while changed:
            changed = False
            allowed: dict[str, list[Kind]] = {}
            for p, branches in found:
                for v, kinds in self._kinds_by_variable(p, branches).items():
                    have = allowed.get(v)
                    allowed[v] = list(kinds) if have is None else [k for k in {*have, *kinds} if any(not k.disjoint(h) for h in have) and any(not k.disjoint(x) for x in kinds)]
            for i, (p, branches) in enumerate(found):
                fits = [b for b in branches if all(any(not k.disjoint(a) for a in allowed[v]) for v, k in self._own_kinds(p, b))]
                if len(fits) < len(branches):
                    found[i], changed = (p, fits), True
        return [self._sized(p, b) for p, b in found]

    def _branches(self, p: Pattern) -> list[Edges]:
        if isinstance(p.p, Term):
            own = self.graph.edges(p.p.text)
        else:
            whole = self.graph.whole()
            own = [e for es in self.graph.by_predicate.values() for e in es] if whole is None else [whole]
        ok = lambda e: all(not isinstance(n, Term) or k.key(n.text) is not None for n, k in ((p.s, e.s_kind), (p.o, e.o_kind)))
        loop = lambda e: p.s == p.o and isinstance(p.s, Var) and e.s_kind.disjoint(e.o_kind)
        return [e for e in own if ok(e) and not loop(e)]

    def _own_kinds(self, p: Pattern, e: Edges) -> list[tuple[str, Kind]]:
        return [(n.name, k) for n, k in ((p.s, e.s_kind), (p.p, TERM), (p.o, e.o_kind)) if isinstance(n, Var)]

    def _kinds_by_variable(self, p: Pattern, branches: list[Edges]) -> dict[str, set[Kind]]:
        out: dict[str, set[Kind]] = {v: set() for v in p.variables}
        for e in branches:
            for v, k in self._own_kinds(p, e):
                out[v].add(k)
        return out

    def _sized(self, p: Pattern, branches: list[Edges]) -> Access:
        rows, values = 0.0, dict.fromkeys(p.variables, 0.0)
        for e in branches:
            n: Sizes = e.sizes
            own = n.edges / (max(n.subjects, 1) if isinstance(p.s, Term) else 1) / (max(n.objects, 1) if isinstance(p.o, Term) else 1)
            own = own / max(n.subjects, n.objects, 1) if p.s == p.o and isinstance(p.s, Var) else own
            rows += own
            for node, most in ((p.s, n.subjects), (p.o, n.objects), (p.p, n.predicates)):
                if isinstance(node, Var):
                    values[node.name] += min(most, own)
        return Access(p, branches, rows, values)

    def relation(self, access: Access) -> Relation:
        """The matches of one pattern. Branches of one kind stay typed, others are rendered."""
        if access.parts:
            return self._star(access.parts)
        p, branches = access.pattern, access.branches
        columns = {v: self.column(v) for v in p.variables}
        if not branches:
            return Relation(self._empty(columns.values()), dict.fromkeys(columns.values(), TERM))
        kinds = {v: next(iter(ks)) if len(ks) == 1 else TERM for v, ks in self._kinds_by_variable(p, branches).items()}
        out = None
        for e in branches:
            df = e.df
            for name, node, kind in (("s", p.s, e.s_kind), ("o", p.o, e.o_kind)):
                if isinstance(node, Term):
                    df = df.filter(F.col(name) == F.lit(kind.key(node.text)))
            slots: dict[str, list[tuple[Column, Kind]]] = {}
            for node, value, kind in ((p.s, F.col("s"), e.s_kind), (p.p, F.col("p") if e.predicate is None else F.lit(e.predicate), TERM), (p.o, F.col("o"), e.o_kind)):
                if isinstance(node, Var):
                    slots.setdefault(node.name, []).append((value, kind))
            for same in slots.values():
                for (a, ka), (b, kb) in zip(same, same[1:], strict=False):
                    df = df.filter(a == b if ka == kb else ka.render(a) == kb.render(b))
            df = df.select(*((v if kinds[n] == k else k.render(v)).alias(columns[n]) for n, ((v, k), *_) in slots.items()))
            out = df if out is None else out.unionByName(df)
        return Relation(out, {columns[v]: k for v, k in kinds.items()})

    def _empty(self, columns: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) or "one int")

    # Joins ------------------------------------------------------------------------------------

    def _aligned(self, a: Relation, b: Relation) -> tuple[Relation, Relation, list[str]]:
        shared = [c for c in a.kinds if c in b.kinds]
        differ = [c for c in shared if a.kinds[c] != b.kinds[c]]
        return a.rendered(differ), b.rendered(differ), shared

    def _join(self, a: Relation, b: Relation) -> Relation:
        a, b, shared = self._aligned(a, b)
        how = "left_semi" if set(b.kinds) <= set(a.kinds) else "inner"
        return Relation(a.df.join(b.df, shared, how), {**a.kinds, **b.kinds})

    def component(self, members: list[Access], shown: frozenset[str] = frozenset()) -> Relation:
        """The join of these patterns. ``shown``: columns that are only rendered after it."""
        if self.strategy == "join" and self.choose is None:
            members = self._stars(members)
        candidates = [Candidate(m.pattern, m.rows, m.values, m.names) for m in members]
        by = {id(c): m for c, m in zip(candidates, members, strict=True)}
        after: list[float] = []
        if self.choose is not None and len(candidates) > 1:
            order = order_by_variables(candidates, variable_order(candidates, self.choose))
        else:
            order, after = planned(candidates)
        if self.strategy == "intersect" and is_cycle(candidates):
            return self._closed([by[id(c)] for c in order])
        out = None
        for i, c in enumerate(order):
            r = self.relation(by[id(c)])
            if out is not None and after and after[i] > MULTIPLIES * max(after[i - 1], c.rows):
                later = {self.column(v) for x in order[i + 1 :] for v in x.variables}
                out, r = self._multiplied(out, r, by[id(c)], shown - later, after[i])
            out = r if out is None else self._join(out, r)
        return out

    def _multiplied(self, a: Relation, b: Relation, access: Access, shown: frozenset[str], rows: float) -> tuple[Relation, Relation]:
        """Two sides of a join that multiplies rows: terms are rendered before it, once for each
        row of a side, and few keys do not make few tasks: a side that is small is broadcast, and
        the other is dealt into as many tasks as the result needs. It is dealt as keys, before its
        terms are rendered, by ranges of what is joined on: a task then repeats few rows of the small
        side in one order, which takes little room where it is written."""
        shared = set(a.kinds) & set(b.kinds)
        small = sum(e.sizes.edges for e in access.branches) <= SMALL_SIDE and not set(b.kinds) <= set(a.kinds)
        if small:
            a, b, on = self._aligned(a, b)
            tasks = min(MOST_TASKS, math.ceil(rows / TASK_ROWS))
            if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                order = [*on, *(c for c in a.kinds if c not in shared)]
                a = Relation(a.df.repartitionByRange(tasks, *order), a.kinds, a.nullable)
        a, b = (x.rendered([n for n in x.kinds if n in shown - shared]) for x in (a, b))
        return (a, Relation(F.broadcast(b.df), b.kinds, b.nullable)) if small else (a, b)

    def _stars(self, members: list[Access]) -> list[Access]:
        """Patterns around one subject that are columns of one table become one access."""
        groups: dict[object, list[Access]] = {}
        for m in members:
            star = m.branches[0].star if len(m.branches) == 1 else None
            if star is None or not isinstance(m.pattern.p, Term) or m.pattern.s == m.pattern.o:
                groups[id(m)] = [m]
                continue
            group = groups.setdefault((m.pattern.s, star.table, star.s), [])
            kinds = {a.pattern.o: a.branches[0].o_kind for a in group}
            if kinds.get(m.pattern.o, m.branches[0].o_kind) != m.branches[0].o_kind:
                groups[id(m)] = [m]  # one variable for columns of two kinds
            else:
                group.append(m)
        return [g[0] if len(g) == 1 else self._as_one(g) for g in groups.values() if g]

    def _as_one(self, parts: list[Access]) -> Access:
        total = max(a.branches[0].sizes.edges for a in parts)
        rows = total
        for a in parts:
            rows *= min(1.0, a.rows / max(total, 1.0))
        values: dict[str, float] = {}
        for a in parts:
            for v, n in a.values.items():
                values[v] = min(values.get(v, n), n, max(rows, 1.0))
        return Access(parts[0].pattern, parts[0].branches, rows, values, parts)

    def _star(self, parts: list[Access]) -> Relation:
        first = parts[0].branches[0]
        df = first.star.base().select(F.expr(first.star.s).alias("s"), *(F.expr(a.branches[0].star.o).alias(f"o{i}") for i, a in enumerate(parts)))
        slots: dict[str, tuple[str, Kind]] = {}
        for name, node, kind in (("s", parts[0].pattern.s, first.s_kind), *((f"o{i}", a.pattern.o, a.branches[0].o_kind) for i, a in enumerate(parts))):
            if isinstance(node, Term):
                df = df.filter(F.col(name) == F.lit(kind.key(node.text)))
                continue
            df = df.filter(F.col(name).isNotNull())
            if node.name in slots:
                df = df.filter(F.col(name) == F.col(slots[node.name][0]))
            else:
                slots[node.name] = name, kind
        df = df.select(*(F.col(c).alias(self.column(v)) for v, (c, _) in slots.items()))
        return Relation(df, {self.column(v): k for v, (_, k) in slots.items()})

    def _closed(self, order: list[Access]) -> Relation:
        """A cycle: joins up to the variable that closes it, which comes from the intersection
        of the lists of its two neighbours."""
        *path, before, last = order
        out = None
        for m in path:
            r = self.relation(m)
            out = r if out is None else self._join(out, r)
        a, b = self.relation(before), self.relation(last)
        closing = [c for c in a.kinds if c in b.kinds and out is not None and c not in out.kinds]
        if out is None or len(closing) != 1:
            return self._join(self._join(out, a) if out is not None else a, b)
        value = closing[0]
        a, b, _ = self._aligned(a, b)
        pairs = []
        for r in (a, b):
            key = next((c for c in r.kinds if c != value), None)
            if key is None or key not in out.kinds:
                return self._join(self._join(out, a), b)
            out, r, _ = self._aligned(out, r)
            pairs.append((r, key))
        made = extend(out.df, value, [(r.df, key) for r, key in pairs], self.max_degree)
        if made is None:
            return self._join(self._join(out, a), b)
        return Relation(made, out.kinds | {value: pairs[0][0].kinds[value]})

    def group(self, group: Group, limit: int | None = None, shown: frozenset[str] = frozenset()) -> Relation:
        """Solutions of a group. ``limit``: that many suffice, and no filter follows. ``shown``:
        columns that are only rendered after it."""
        shown = frozenset() if group.filters or group.optionals else shown
        accesses = self.accesses(group.patterns)
        candidates = [Candidate(a.pattern, a.rows, a.values) for a in accesses]
        by = dict(zip(map(id, candidates), accesses, strict=True))
        out = None
        # ground patterns: the group has solutions only if they match
        ground = [self.relation(a).df.limit(1).select(F.lit(1).alias("one")) for a in accesses if not a.pattern.variables]
        parts = sorted(components(candidates), key=lambda m: (min(c.rows for c in m), len(m)))
        if limit is not None and len(parts) == 1 and not ground and not group.filters and not group.optionals:
            limit = None  # the caller limits it anyway
        push = limit is not None and not group.filters and not group.optionals
        for members in parts:
            r = self.component([by[id(c)] for c in members], shown)
            r = Relation(r.df.limit(limit), r.kinds) if push else r
            out = r if out is None else Relation(out.df.crossJoin(r.df), {**out.kinds, **r.kinds})
        if out is None:
            out = Relation(self.spark.range(1).select(F.lit(1).alias("one")), {})
        for g in ground:
            out = Relation(out.df.join(F.broadcast(g.select(F.col("one").alias("g1"))), F.lit(True), "left_semi"), out.kinds)
        inner = set(out.kinds)
        late = []
        for test in group.filters:
            if all(self.column(v.name) in inner for v in (test.left, test.right) if isinstance(v, Var)):
                out = Relation(out.df.filter(self.test(test, out)), out.kinds, out.nullable)
            else:
                late.append(test)
        for o in group.optionals:
            out = self._optional(out, o)
        for test in late:
            out = Relation(out.df.filter(self.test(test, out)), out.kinds, out.nullable)
        return out

    def _optional(self, a: Relation, group: Group) -> Relation:
        """Left join. Filters of the group that name outer variables are part of its condition."""
        own = group.variables()
        inside = [t for t in group.filters if all(v.name in own for v in (t.left, t.right) if isinstance(v, Var))]
        across = [t for t in group.filters if t not in inside]
        b = self.group(Group(group.patterns, inside, group.optionals))
        a, b, shared = self._aligned(a, b)
        df = b.df.select(*(F.col(c).alias(f"r_{c}") for c in b.kinds))
        both = Relation(a.df, {**b.kinds, **a.kinds})
        # rows are told apart by which of their shared variables are bound: on those, the join
        # stays one of equal keys, and an unbound one agrees with anything
        maybe = [c for c in shared if c in a.nullable]
        joined = None
        for unbound in (set(x) for n in range(len(maybe) + 1) for x in itertools.combinations(maybe, n)):
            rows = a.df
            for c in maybe:
                rows = rows.filter(F.col(c).isNull() if c in unbound else F.col(c).isNotNull())
            condition = F.lit(True)
            for c in shared:
                if c not in unbound:
                    same = F.col(c) == F.col(f"r_{c}")
                    condition = condition & (same | F.col(f"r_{c}").isNull() if c in b.nullable else same)
            for t in across:
                condition = condition & self.test(t, both, {c: f"r_{c}" for c in b.kinds if c not in a.kinds})
            found = rows.join(df, condition, "left")
            joined = found if joined is None else joined.union(found)
        new = [c for c in b.kinds if c not in a.kinds]
        columns = [(F.coalesce(F.col(c), F.col(f"r_{c}")) if c in shared else F.col(c)).alias(c) for c in a.kinds]
        out = joined.select(*columns, *(F.col(f"r_{c}").alias(c) for c in new))
        return Relation(out, {**a.kinds, **{c: b.kinds[c] for c in new}}, a.nullable | frozenset(new))

    # Filters ----------------------------------------------------------------------------------

    def test(self, t: Test, r: Relation, rename: dict[str, str] | None = None) -> Column:
        """A comparison. Where it is an error (unbound, or of what cannot be compared) the row
        goes. Numbers compare by value, literals by their text, IRIs only by equality."""
        flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}
        left, op, right = t.left, t.op, t.right
        if not isinstance(left, Var) and isinstance(right, Var):
            left, op, right = right, flip[op], left
        if not isinstance(left, Var):
            return F.lit(_constant(left, op, right))

        def value(v: Var) -> tuple[Column, Kind] | None:
            c = self.column(v.name)
            return (F.col((rename or {}).get(c, c)), r.kinds[c]) if c in r.kinds else None

        a = value(left)
        b = value(right) if isinstance(right, Var) else None
        if a is None or isinstance(right, Var) and b is None:
            return F.lit(False)
        if isinstance(right, Number):
            return F.coalesce(_compare(_number(*a), op, F.lit(right.value)), F.lit(False))
        if isinstance(right, Var):
            if op in ("=", "!="):
                x, y = a[1].render(a[0]), b[1].render(b[0])
                return F.coalesce(_compare(x, op, y), F.lit(False))
            both = F.when(_number(*a).isNotNull() & _number(*b).isNotNull(), _compare(_number(*a), op, _number(*b))).otherwise(_compare(_text(*a), op, _text(*b)))
            return F.coalesce(both, F.lit(False))
        if op in ("=", "!="):
            return F.coalesce(_compare(a[1].render(a[0]), op, F.lit(right.text)), F.lit(False))
        return F.coalesce(_compare(_text(*a), op, _text(F.lit(right.text), TERM)), F.lit(False))

    # Queries ----------------------------------------------------------------------------------

    def run(self, query: Query | str) -> DataFrame:
        q = parse(query) if isinstance(query, str) else query
        plain = q.modifier in (None, "REDUCED", "DUPLICATES")
        shown = frozenset(map(self.column, q.columns())) if plain and q.limit is None else frozenset()
        found = self.group(q.where, q.limit if plain else None, shown)
        if q.modifier == "COUNT":
            out = found.df.agg(F.count("*").alias("count"))
            return out if q.limit is None else out.limit(q.limit)
        columns = [(found.kinds[c].render(F.col(c)) if c in found.kinds else F.lit(None).cast("string")).cast("string").alias(f"c{i}") for i, c in enumerate(map(self.column, q.columns()))]
        if not columns:  # no variable at all: one row if there is a solution
            return found.df.select(F.lit(True).alias("exists"))
        if q.modifier == "DISTINCT":
            # keys are as good as terms to tell solutions apart
            kept = [c for c in map(self.column, q.columns()) if c in found.kinds]
            found = Relation(found.df.select(*kept).distinct(), {c: found.kinds[c] for c in kept})
        out = found.df if q.limit is None else found.df.limit(q.limit)
        return out.select(*columns).toDF(*q.columns())


def _number(c: Column, kind: Kind) -> Column:
    if kind == INTEGER:
        return c.cast("double")
    if kind not in (TERM, TEXT):
        return F.lit(None).cast("double")
    text = c if kind == TEXT else F.regexp_extract(c, r'^"?([^"]*)"?(?:\^\^<[^>]*>)?\z', 1)
    return text.try_cast("double")


def _text(c: Column, kind: Kind) -> Column:
    if kind.literal:
        return c.cast("string")
    return F.when(c.rlike('^"'), F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)) if kind == TERM else F.lit(None).cast("string")


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _constant(left: Term | Number, op: str, right: Term | Number) -> bool:
    a, b = (x.value if isinstance(x, Number) else x.text for x in (left, right))
    if type(a) is not type(b):
        return op == "!="
    if isinstance(a, float) and math.isnan(a):
        return False
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def run_query(graph: Graph, text: str, **options) -> DataFrame:
    return Matcher(graph, **options).run(text)


def candidates(graph: Graph, text: str) -> list[Candidate]:
    """The patterns of a query's own group with their sizes: what order choosers are about."""
    m = Matcher(graph)
    return [Candidate(a.pattern, a.rows, a.values) for a in m.accesses(parse(text).where.patterns)]
