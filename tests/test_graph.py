"""The engine against a plain matcher, on a hand-made graph and on random ones."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.kinds import INTEGER, TEXT, iri
from tessera.functions.terms import escape_nt, unescape_nt
from tessera.operators.bgp import Matcher, candidates, run_query
from tessera.operators.graph import Edges, Graph, Sizes
from tessera.operators.intersect import intersect_sets
from tessera.operators.results import iterate, print_result, result_stats, show, stream_rows
from tessera.plans.learned import LearnedOrder, expected_cost
from tessera.plans.planner import Candidate, VariableGraph, components, is_cycle, join_order, variable_order
from tessera.plans.sparql import Pattern, Term, Var, parse

TRIPLES = [
    ("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<c>", "<p>", "<a>"), ("<a>", "<p>", "<a>"), ("<a>", "<q>", "<c>"), ("<b>", "<q>", "<c>"),
    ("<c>", "<q>", '"x"@en'), ("<d>", "<r>", '"5"^^<int>'), ("<d>", "<r>", '"plain"'), ("_:n", "<r>", '"a . b \\" c"'), ("<e>", "<r>", '"é"'), ("<q>", "<s>", "<a>"), ("<a>", "<s>", "<q>"),
]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.of_triples(spark.createDataFrame(TRIPLES, "s string, p string, o string").cache())


def match(patterns, triples):
    """All solutions, the plain way."""
    found = [{}]
    for p in patterns:
        out = []
        for row, t in itertools.product(found, triples):
            new = dict(row)
            for node, value in zip(p.nodes, t, strict=True):
                if isinstance(node, Term):
                    if node.text != value:
                        break
                elif new.setdefault(node.name, value) != value:
                    break
            else:
                out.append(new)
        found = out
    return found


def check(graph, text, triples=TRIPLES, **options):
    q = parse(text)
    want = Counter(tuple(r.get(c) for c in q.columns()) for r in match(dict.fromkeys(q.where.patterns), triples))
    df = run_query(graph, text, **options)
    assert df.columns == q.columns()
    assert Counter(map(tuple, df.collect())) == want
    return want


@pytest.mark.parametrize(
    "where",
    [
        "?a <p> ?b", "?a <p> ?a", "?a <p> ?b . ?b <p> ?c . ?c <p> ?a", "<a> ?p <b>", "<a> ?p ?o", "?s ?p <c>", "?s ?p ?o", "?s <r> ?o", "?s <q> ?o . ?x <r> ?y",
        "?s ?p ?o . ?p <s> ?z", "?a <s> ?p . ?x ?p ?y", "<a> <p> <b> . ?x <q> ?y", "<a> <p> <zzz> . ?x <q> ?y", "?x <none> ?y . ?x <p> ?z", '?s <r> "plain"', '?s <r> "a . b \\" c"',
        "?a <p> ?b . ?a <p> ?b", "?x ?x ?y", "?x ?y ?x", "?a <p> ?b . ?a <q> ?c . ?b <q> ?c", '?s <r> "\\u00E9"', "?a <p> ?b . ?c <q> ?d . ?e <s> ?f",
    ],
)
def test_patterns(graph, where):
    check(graph, f"SELECT * WHERE {{ {where} }}")


def test_projection_is_a_bag(graph):
    assert sum(check(graph, "SELECT ?a WHERE { ?a <p> ?b . ?a <q> ?c }").values()) == 4
    assert run_query(graph, "SELECT DISTINCT ?a WHERE { ?a <p> ?b }").count() == 3
    assert check(graph, "SELECT ?b ?a ?b WHERE { ?a <p> ?b }")


def test_unbound_and_case(graph):
    df = run_query(graph, "SELECT ?X ?x ?none WHERE { ?X <p> ?x }")
    assert df.columns == ["X", "x", "none"] and {tuple(r) for r in df.collect()} == {(s, o, None) for s, p, o in TRIPLES if p == "<p>"}


def test_count_limit_and_ground(graph):
    assert run_query(graph, "SELECT COUNT ?a WHERE { ?a <p> ?b . ?c <q> ?d }").first()[0] == 12
    assert run_query(graph, "SELECT * WHERE { ?a <p> ?b . ?c <q> ?d } LIMIT 5").count() == 5
    assert run_query(graph, "SELECT * WHERE { ?a <p> ?b } LIMIT 0").count() == 0
    assert run_query(graph, "SELECT DISTINCT ?a WHERE { ?a <p> ?b } LIMIT 2").count() == 2
    assert run_query(graph, "SELECT * WHERE { <a> <p> <b> }").count() == 1 and run_query(graph, "SELECT * WHERE { <a> <p> <z> }").count() == 0


def test_optional(graph):
    rows = {tuple(r) for r in run_query(graph, "SELECT ?a ?c WHERE { ?a <p> ?b . OPTIONAL { ?a <q> ?c } }").collect()}
    assert rows == {("<a>", "<c>"), ("<b>", "<c>"), ("<c>", '"x"@en')}
    rows = Counter(tuple(r) for r in run_query(graph, "SELECT ?a ?c ?d WHERE { ?a <q> ?b . OPTIONAL { ?b <zz> ?c } OPTIONAL { ?c <p> ?d } }").collect())
    assert sum(rows.values()) == 12  # ?c is unbound, so it is compatible with each edge
    rows = {tuple(r) for r in run_query(graph, "SELECT ?s ?o WHERE { ?s <p> <a> . OPTIONAL { ?s <q> ?o . FILTER(?o != <c>) } }").collect()}
    assert rows == {("<a>", None), ("<c>", '"x"@en')}


def test_optional_with_unbound_keys_joins_by_equality(spark):
    triples = [("<1>", "<p>", "<a>"), ("<2>", "<p>", "<b>"), ("<3>", "<p>", "<c>"), ("<1>", "<q>", "<x>"), ("<2>", "<q>", "<y>"), ("<a>", "<r>", "<x>"), ("<a>", "<r>", "<z>"), ("<b>", "<r>", "<x>"), ("<c>", "<r>", "<w>")]
    g = Graph.of_triples(spark.createDataFrame(triples, "s string, p string, o string").cache())
    df = run_query(g, "SELECT ?s ?k ?t WHERE { ?s <p> ?m . OPTIONAL { ?s <q> ?k } OPTIONAL { ?m <r> ?k . ?t <r> ?k } }")
    # <1>: k is <x>; <2>: <b> has no <y>; <3>: k was unbound and comes from <c>
    want = Counter([("<1>", "<x>", "<a>"), ("<1>", "<x>", "<b>"), ("<2>", "<y>", None), ("<3>", "<w>", "<c>")])
    assert Counter(map(tuple, df.collect())) == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_following(spark):
    from datetime import datetime, timedelta

    from tessera.sources.tables import following

    rng = random.Random(5)
    start = datetime(2024, 2, 28, 23, 58)
    rows = [(i, start + timedelta(seconds=rng.choice([rng.randrange(240), rng.randrange(400000)])), rng.choice(["a", "b"]), rng.choice([None, *range(30)])) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, user_id long")
    for kind in ("a", "b", "c"):
        own = [r[3] for r in sorted((r for r in rows if r[2] == kind), key=lambda r: (r[1], r[0]))]
        want = {(x, y) for x, y in itertools.pairwise(own) if x is not None and y is not None}
        assert sorted(map(tuple, following(events, kind).collect())) == sorted(want)


def test_filters(spark):
    node = iri("n", "http://e/")
    rows = spark.createDataFrame([(1, 5, "b"), (2, 7, "a"), (3, 10, "10")], "n long, i int, t string")
    sizes = lambda: Sizes(3, 3, 3)
    g = Graph(spark, [Edges("<i>", node, INTEGER, lambda: rows.select(F.col("n").alias("s"), F.col("i").alias("o")), sizes), Edges("<t>", node, TEXT, lambda: rows.select(F.col("n").alias("s"), F.col("t").alias("o")), sizes)])
    n = lambda test: sorted(int(r[0][len("<http://e/n/") : -1]) for r in run_query(g, f"SELECT ?n WHERE {{ ?n <i> ?i . ?n <t> ?t . FILTER({test}) }}").collect())
    assert n("?i = 5") == [1] and n("?i != 5") == [2, 3] and n("?i < 10") == [1, 2] and n("10 <= ?i") == [3] and n("?i > 5 && ?i < 10") == [2]
    assert n('?t = "a"') == [2] and n('?t < "b"') == [2, 3] and n("?t >= 10") == [3] and n("?t = ?i") == [3] and n("?n = <http://e/n/2>") == [2] and n("?n < 5") == [] and n("?none = 1") == []
    assert run_query(g, 'SELECT ?a ?b WHERE { ?a <i> ?x . ?b <t> ?x }').collect() == [("<http://e/n/3>", "<http://e/n/3>")]  # "10" of both kinds


def random_graph(rng, n, m):
    return sorted({(f"<{rng.randrange(n)}>", f"<p{rng.randrange(3)}>", f"<{rng.randrange(n)}>") for _ in range(m)})


def random_where(rng):
    names, out = ["?a"], []
    for _ in range(rng.randint(1, 4)):
        s = rng.choice(names)
        o = rng.choice([*names, f"?{chr(97 + len(names))}", f"<{rng.randrange(6)}>"])
        if o.startswith("?") and o not in names:
            names.append(o)
        p = rng.choice(["<p0>", "<p1>", "<p2>", "?p"])
        out.append(f"{s} {p} {o}" if rng.random() < 0.5 else f"{o} {p} {s}")
    return out


def test_random_patterns(spark):
    rng = random.Random(12)
    triples = random_graph(rng, 6, 40)
    graph = Graph.of_triples(spark.createDataFrame(triples, "s string, p string, o string").coalesce(1).cache())
    for _ in range(12):
        where = random_where(rng)
        check(graph, f"SELECT * WHERE {{ {' . '.join(where)} }}", triples)
        rng.shuffle(where)
        check(graph, f"SELECT * WHERE {{ {' . '.join(where)} }}", triples)


@pytest.mark.parametrize("cycle", ["?a <p0> ?b . ?b <p1> ?c . ?c <p2> ?a", "?a <p0> ?b . ?c <p1> ?b . ?c <p2> ?a", "?a <p0> ?b . ?b <p1> ?c . ?c <p2> ?d . ?d <p0> ?a"])
def test_intersection(spark, cycle):
    rng = random.Random(13)
    triples = random_graph(rng, 8, 60)
    graph = Graph.of_triples(spark.createDataFrame(triples, "s string, p string, o string").coalesce(1).cache())
    check(graph, f"SELECT * WHERE {{ {cycle} }}", triples, strategy="intersect")
    check(graph, f"SELECT * WHERE {{ {cycle} }}", triples, strategy="intersect", max_degree=1)
    with pytest.raises(ValueError):
        Matcher(graph, strategy="other")


def test_access_paths(graph):
    one = lambda df: sorted(r[0] for r in df.collect())
    assert one(graph.subjects("<q>")) == ["<a>", "<b>", "<c>"] and one(graph.objects("<p>")) == ["<a>", "<b>", "<c>"]
    assert one(graph.predicates_of_subject("<a>")) == ["<p>", "<q>", "<s>"] and one(graph.predicates_of_object("<c>")) == ["<p>", "<q>"]
    assert one(graph.objects_of("<a>", "<p>")) == ["<a>", "<b>"] and one(graph.subjects_of("<a>", "<p>")) == ["<a>", "<c>"]
    assert one(graph.predicates_between("<b>", "<c>")) == ["<p>", "<q>"]
    assert one(graph.all_objects("<a>")) == ["<a>", "<b>", "<c>", "<q>"] and one(graph.all_subjects("<c>")) == ["<a>", "<b>"]
    assert one(intersect_sets([graph.subjects("<p>"), graph.subjects("<q>"), graph.objects("<s>")])) == ["<a>"]


def test_stats(graph):
    assert {tuple(r) for r in graph.predicate_stats().collect()} == {("<p>", 4, 3, 3), ("<q>", 3, 3, 2), ("<r>", 4, 3, 4), ("<s>", 2, 2, 2)}
    assert graph.database_stats().first().asDict() == {"subject_count": 3, "object_count": 5, "shared_count": 4, "entity_count": 12, "predicate_count": 4, "triple_count": 13}
    roles = dict(map(tuple, graph.roles().collect()))
    assert roles["<a>"] == "shared" and roles["_:n"] == "subject" and roles['"plain"'] == "object"
    sets = {tuple(r.predicates): r.entities for r in graph.characteristic_sets().collect()}
    assert sets == {("<p>", "<q>", "<s>"): 1, ("<p>", "<q>"): 2, ("<r>",): 3, ("<s>",): 1}
    assert graph.characteristic_set_of("<b>").first()[0] == ["<p>", "<q>"] and graph.with_predicates(["<q>", "<p>"]).first()[1] == 2
    degrees = dict(map(tuple, graph.degrees("s").collect()))
    assert degrees["<a>"] == 4 and degrees["<d>"] == 2
    ids = graph.dictionary().collect()
    assert sorted(r.id for r in ids) == list(range(1, 13))
    terms = [(r.role, r.term) for r in sorted(ids, key=lambda r: r.id)]
    assert terms == sorted(terms, key=lambda x: (["shared", "subject", "object"].index(x[0]), x[1].encode()))
    assert [r.role for r in sorted(ids, key=lambda r: r.id)] == ["shared"] * 4 + ["subject"] * 3 + ["object"] * 5


def test_results(graph, capsys):
    df = run_query(graph, "SELECT ?a ?b WHERE { ?a <p> ?b }")
    shown = show(df, cap=3)
    assert (shown.count, len(shown.rows), shown.truncated) == (4, 3, True)
    d = shown.as_dict(3)
    assert d["head"]["vars"] == ["?a", "?b"] and d["results"]["truncated"] and d["results"]["count"] == 4
    assert result_stats(df).first().asDict() == {"rows": 4, "cells": 8, "filled": 8, "chars": 24, "filled_percent": 100.0, "mean_chars": 3.0}
    stats = show(run_query(graph, "SELECT ?s ?o ?x WHERE { ?s <r> ?o . OPTIONAL { ?s <none> ?x } }")).as_dict(9)["query_stats"]
    assert (stats["cell_count"], stats["non_empty_cells"], stats["total_cell_count"]) == (12, 8, 12)
    assert stats["avg_value_chars"] == sum(len(s.encode()) + len(o.encode()) for s, p, o in TRIPLES if p == "<r>") / 12
    got = []
    assert stream_rows(df, got.append, 2) == 2 and len(got) == 2 and len(list(iterate(df))) == 4
    assert print_result(df) == 4 and "?a\t?b" in capsys.readouterr().out


def test_escape_columns(spark):
    from tessera.functions.terms import escape, unescape

    b = chr(92)
    texts = ["plain", "é", "\U0001f600", f"{b}u00e9{b}u00E9x", f"a{b}uD83D{b}uDE00b{b}U0001F600", f"A{b}uZZZZ", f"{b}uD83D x", f"{b}uD83D{b}u0041", f"{b}U00110000{b}U0000000041", f"{b}uD83D{b}uDE00{b}uD83D{b}uDE00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", escape_nt(F.col("t")), unescape_nt(F.col("t"))).collect():
        assert (e, u) == ((None, None) if t is None else (escape(t), unescape(t)))


def test_plan_order():
    c = lambda s, p, o, rows, **values: Candidate(Pattern(*(Var(x[1:]) if x[0] == "?" else Term(x) for x in (s, p, o))), rows, values)
    big, mid, one = c("?a", "p", "?b", 1e6, a=1e3, b=1e6), c("?b", "q", "?c", 1e4, b=1e4, c=1e2), c("?c", "r", "x", 1, c=1)
    assert join_order([big, mid, one]) == [one, mid, big]
    assert [len(x) for x in components([big, c("?z", "p", "?y", 5, z=5, y=5), mid])] == [1, 2]
    assert is_cycle([big, mid, c("?c", "s", "?a", 10, c=10, a=10)]) and not is_cycle([big, mid])
    graph = VariableGraph.of([big, mid, one])
    assert graph.vertices == ["a", "b", "c"] and graph.degree == [1, 2, 1] and graph.choose() == "b"
    graph.update("b", 50)
    assert graph.as_dict()["est_size"][0] == 50 and graph.status == [1, -1, 1]
    assert variable_order([big, mid, one]) == ["b", "a", "c"]
    assert variable_order([big, mid, one], lambda g: "c" if g["status"][2] == 1 else "nonsense")[0] == "c"


def test_plan_multiplies_late():
    c = lambda a, b, rows, **values: Candidate(Pattern(Var(a), Term("p"), Var(b)), rows, values)
    placed, lives, supplies = c("o", "c", 9e6, o=9e6, c=9e5), c("c", "n", 9e5, c=9e5, n=25), c("s", "n", 6e4, s=6e4, n=25)
    assert join_order([placed, lives, supplies]) == [lives, placed, supplies]


def test_terms_before_multiplying_join(spark, monkeypatch):
    """Terms of sides are rendered once for each of their rows, and few keys make many tasks."""
    from tessera.operators import bgp

    monkeypatch.setattr(bgp, "TASK_ROWS", 200)
    near, city = iri("near", "http://x/"), iri("city", "http://x/")

    def edges(name, n, first):
        rows = spark.range(first, first + n).selectExpr("id AS s", "id % 3 AS o")
        return Edges(f"<{name}>", near, city, lambda: rows, lambda: Sizes(n, n, 3))

    g = Graph(spark, [edges("p", 90, 0), edges("q", 60, 1000)])
    df = run_query(g, "SELECT ?a ?b WHERE { ?a <p> ?n . ?b <q> ?n }")
    got = Counter(map(tuple, df.collect()))
    term = lambda i: f"<http://x/near/{i}>"
    assert got == Counter((term(a), term(b)) for a in range(90) for b in range(1000, 1060) if a % 3 == b % 3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 2 and "concat(" not in plan[: plan.index("Join")]
    assert df.rdd.getNumPartitions() == 9
    assert run_query(g, "SELECT COUNT ?a ?b WHERE { ?a <p> ?n . ?b <q> ?n }").collect()[0][0] == 1800
    assert run_query(g, "SELECT DISTINCT ?n WHERE { ?a <p> ?n . ?b <q> ?n . FILTER(?n != <http://x/city/0>) }").count() == 2


def test_multiplied_rows_lie_by_key(spark, monkeypatch):
    """A task of a join that multiplies rows has few keys, and its side is dealt as keys, not terms."""
    from tessera.operators import bgp

    monkeypatch.setattr(bgp, "TASK_ROWS", 200)
    near, city = iri("near", "http://x/"), iri("city", "http://x/")

    def edges(name, n, first):
        rows = spark.range(first, first + n).selectExpr("id AS s", "id % 3 AS o")
        return Edges(f"<{name}>", near, city, lambda: rows, lambda: Sizes(n, n, 3))

    df = run_query(Graph(spark, [edges("p", 90, 0), edges("q", 60, 1000)]), "SELECT ?a ?b WHERE { ?a <p> ?n . ?b <q> ?n }")
    parts = [rows for rows in df.rdd.glom().collect() if rows]
    assert sum(map(len, parts)) == 1800 and len(parts) == 9
    keys = [len({int(r.a.rsplit("/", 1)[1][:-1]) % 3 for r in rows}) for rows in parts]
    assert max(keys) <= 2 and keys.count(1) >= 7
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression")
    assert "concat(" in plan[:dealt] and "concat(" not in plan[dealt : plan.index("Range (1000,")]


def test_learned_order(graph, tmp_path):
    rng = random.Random(3)

    def query():
        out, names = [], ["v0"]
        for i in range(4):
            a, b = rng.choice(names), f"v{i + 1}"
            names.append(b)
            rows = 10 ** rng.uniform(0, 6)
            out.append(Candidate(Pattern(Var(a), Term("p"), Var(b)), rows, {a: rows ** rng.uniform(0.3, 1), b: rows ** rng.uniform(0.3, 1)}))
        return out

    train, test = [query() for _ in range(40)], [query() for _ in range(20)]
    learner = LearnedOrder(seed=1)
    rewards = learner.train(train, rounds=60)
    assert sum(rewards[-10:]) > sum(rewards[:10])
    cost = lambda choose: sum(math.log(expected_cost(q, variable_order(q, choose))) for q in test)
    chance = lambda g: rng.choice([v for v, s in zip(g["vertices"], g["status"], strict=True) if s == 1] or [None])
    assert cost(learner) < sum(cost(chance) for _ in range(20)) / 20
    learner.save(str(tmp_path / "m.json"))
    again = LearnedOrder.load(str(tmp_path / "m.json"))
    assert LearnedOrder()(VariableGraph.of(test[0]).as_dict()) is None  # knows nothing: the greedy choice holds
    text = "SELECT * WHERE { ?a <p> ?b . ?b <q> ?c . ?c <p> ?d }"
    assert len(candidates(graph, text)) == 3
    check(graph, text, choose=again)
