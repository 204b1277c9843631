"""The registered graph queries: pattern shapes, access paths, statistics, modifiers.

Query texts are in the language that the engine parses; ``:name`` is a predicate of the example
vocabulary. SQL for tests is written from the same text over edges spelled as terms, or by hand
for what is not a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.terms import escape_nt, unescape_nt
from tessera.operators.bgp import run_query
from tessera.operators.graph import Graph
from tessera.operators.intersect import first_values, intersect_sets
from tessera.operators.results import capped, result_stats
from tessera.plans.to_sql import to_sql, triples_cte
from tessera.sources import fs, store, tables
from tessera.sources.tables import predicate

Query = Callable[[SparkSession, str], DataFrame]

PREFIXES = "PREFIX : <http://example.org/p/> PREFIX order: <http://example.org/order/> PREFIX customer: <http://example.org/customer/> PREFIX supplier: <http://example.org/supplier/> PREFIX nation: <http://example.org/nation/> PREFIX region: <http://example.org/region/> PREFIX part: <http://example.org/part/> PREFIX user: <http://example.org/user/> PREFIX doc: <http://example.org/doc/> "

EVENT = {
    "bgp_P2": "SELECT * WHERE { ?a :next_click ?b . ?b :next_error ?c }",
    "bgp_P3": "SELECT * WHERE { ?a :next_click ?b . ?b :next_error ?c . ?c :next_purchase ?d }",
    "bgp_P4": "SELECT * WHERE { user:3 :next_click ?b . ?b :next_error ?c . ?c :next_purchase ?d . ?d :next_signup ?e }",
    "bgp_T2": "SELECT * WHERE { ?a :next_click ?b . ?a :next_error ?c }",
    "bgp_T3": "SELECT * WHERE { ?a :next_click ?b . ?a :next_error ?c . ?a :next_purchase ?d }",
    "bgp_T4": "SELECT * WHERE { user:3 :next_click ?b . user:3 :next_error ?c . user:3 :next_purchase ?d . user:3 :next_signup ?e }",
    "bgp_TI2": "SELECT * WHERE { ?b :next_click ?a . ?c :next_error ?a }",
    "bgp_TI3": "SELECT * WHERE { ?b :next_click ?a . ?c :next_error ?a . ?d :next_purchase ?a }",
    "bgp_TI4": "SELECT * WHERE { ?b :next_click user:3 . ?c :next_error user:3 . ?d :next_purchase user:3 . ?e :next_signup user:3 }",
    "bgp_J3": "SELECT * WHERE { ?b :next_click ?a . ?c :next_error ?a . ?a :next_purchase ?d }",
    "bgp_J4": "SELECT * WHERE { ?b :next_click user:3 . ?c :next_error user:3 . user:3 :next_purchase ?d . user:3 :next_signup ?e }",
    "bgp_Tr1": "SELECT * WHERE { ?a :next_click ?b . ?b :next_error ?c . ?c :next_purchase ?a }",
    "bgp_Tr2": "SELECT * WHERE { ?a :next_click ?b . ?b :next_error ?c . ?a :next_purchase ?c }",
    "bgp_S1": "SELECT * WHERE { ?a :next_click ?b . ?b :next_error ?c . ?c :next_purchase ?d . ?d :next_signup ?a }",
    "bgp_S2": "SELECT * WHERE { ?a :next_click ?b . ?a :next_error ?c . ?d :next_purchase ?b . ?d :next_signup ?c }",
    "bgp_S3": "SELECT * WHERE { ?a :next_click ?b . ?b :next_error ?c . ?c :next_purchase ?d . ?a :next_signup ?d }",
    "bgp_S4": "SELECT * WHERE { ?a :next_click ?b . ?a :next_error ?c . ?b :next_purchase ?d . ?c :next_signup ?d }",
    "tp_self_loop": "SELECT * WHERE { ?a :next_click ?a }",
    "tp_2var_so": "SELECT ?s ?o WHERE { ?s :next_view ?o }",
}

COMMERCE = {
    "wd_L1": "SELECT ?o ?c WHERE { ?o :fulfilledBy supplier:3 . ?c :label ?n . ?o :placedBy ?c }",
    "wd_L2": 'SELECT ?c WHERE { customer:5 :inNation ?n . ?c :segment "FURNITURE" . ?c :inNation ?n }',
    "wd_L3": "SELECT ?p WHERE { ?o :hasPart ?p . ?o :placedBy customer:85 }",
    "wd_L4": 'SELECT ?l WHERE { ?p :brand "Brand#13" . ?p :label ?l }',
    "wd_L5": "SELECT ?c ?g WHERE { ?c :segment ?g . supplier:3 :suppNation ?n . ?c :inNation ?n }",
    "wd_S1": "SELECT ?p ?a ?b ?t ?s WHERE { ?p :label ?a . order:201 :hasPart ?p . ?p :brand ?b . ?p :ptype ?t . ?p :size ?z . ?p :suppliedBy ?s }",
    "wd_S2": 'SELECT ?o ?c WHERE { ?o :placedBy ?c . ?o :status "F" . ?o :priority ?r . ?o :fulfilledBy supplier:3 }',
    "wd_S3": 'SELECT ?p ?l ?s WHERE { ?p :ptype "ECONOMY" . ?p :label ?l . ?p :brand ?b . ?p :suppliedBy ?s }',
    "wd_S4": 'SELECT ?c ?l WHERE { ?c :segment "FURNITURE" . ?c :label ?l . ?o :placedBy ?c . ?c :inNation nation:2 }',
    "wd_S5": 'SELECT ?p ?l WHERE { ?p :ptype "ECONOMY" . ?p :label ?l . ?p :size ?z . ?p :brand "Brand#13" }',
    "wd_S6": "SELECT ?o ?c WHERE { ?o :placedBy ?c . ?o :status ?s . ?o :fulfilledBy supplier:3 }",
    "wd_S7": "SELECT ?t ?l WHERE { ?p :ptype ?t . ?p :label ?l . order:201 :hasPart ?p }",
    "wd_F1": 'SELECT ?p ?o ?r WHERE { ?p :brand "Brand#13" . ?p :ptype ?t . ?o :status ?s . ?o :priority ?r . ?o :hasPart ?p . ?o :fulfilledBy supplier:3 }',
    "wd_F2": "SELECT ?o ?c ?l ?n WHERE { ?o :placedBy ?c . ?o :status ?s . ?o :priority ?r . ?c :label ?l . ?c :segment ?g . ?c :inNation ?n . ?o :fulfilledBy supplier:3 }",
    "wd_F3": 'SELECT ?p ?o ?c WHERE { ?p :label ?l . ?p :size ?z . ?p :brand "Brand#13" . ?o :hasPart ?p . ?o :placedBy ?c . ?o :priority ?r }',
    "wd_F4": 'SELECT ?p ?o ?s ?m WHERE { ?p :label ?l . ?o :hasPart ?p . ?p :brand "Brand#13" . ?p :size ?z . ?p :suppliedBy ?s . ?s :label ?m . ?s :suppNation nation:15 . ?o :status ?x }',
    "wd_F5": "SELECT ?p ?s ?m WHERE { ?p :brand ?b . order:201 :hasPart ?p . ?p :suppliedBy ?s . ?s :label ?m . ?s :suppNation ?n . ?p :size ?z }",
    "wd_C1": "SELECT ?o ?c ?s ?m WHERE { ?o :status ?a . ?o :priority ?b . ?o :placedBy ?c . ?c :inNation ?n . ?s :suppNation ?n . ?s :label ?m }",
    "wd_C2": "SELECT ?o ?c ?p ?s WHERE { ?o :placedBy ?c . ?c :inNation nation:2 . ?o :hasPart ?p . ?p :suppliedBy ?s . ?s :suppNation ?n . ?n :inRegion ?r . ?r :label ?x }",
    "wd_C3": "SELECT ?c WHERE { ?c :label ?a . ?c :segment ?b . ?c :inNation ?n . ?o :placedBy ?c }",
    "bgp_cartesian": 'SELECT * WHERE { ?n :inRegion region:1 . ?c :segment "FURNITURE" }',
    "bgp_cartesian_empty": 'SELECT * WHERE { ?n :inRegion ?r . ?p :brand "Brand#999" }',
    "bgp_pred_join": "SELECT ?p ?x WHERE { nation:2 ?p ?r . nation:3 ?p ?x }",
    "bgp_nested_group": "SELECT ?c ?n WHERE { { ?c :inNation ?n . { ?n :inRegion region:1 } } }",
    "tp_1var_subject": "SELECT ?c WHERE { ?c :inNation nation:2 }",
    "tp_1var_predicate": "SELECT ?p WHERE { nation:0 ?p region:0 }",
    "tp_1var_object": "SELECT ?p WHERE { order:201 :hasPart ?p }",
    "tp_2var_sp": "SELECT ?s ?p WHERE { ?s ?p nation:2 }",
    "tp_2var_po": "SELECT ?p ?o WHERE { customer:5 ?p ?o }",
    "tp_ground_exists": "SELECT ?n WHERE { ?n :inRegion region:1 . customer:5 :segment ?g . order:201 :status ?s . nation:0 :inRegion region:0 }",
    "tp_unknown_const": "SELECT ?a WHERE { ?a :noSuchPredicate ?b . ?a :inNation ?n }",
    "proj_bag": "SELECT ?n WHERE { ?c :inNation ?n . ?o :placedBy ?c }",
    "proj_star": "SELECT * WHERE { ?x10 :suppNation ?x2 . ?x2 :inRegion ?x1 }",
    "proj_distinct": "SELECT DISTINCT ?n ?g WHERE { ?c :inNation ?n . ?c :segment ?g . ?o :placedBy ?c }",
    "proj_unbound": "SELECT ?n ?nothing WHERE { ?n :inRegion region:1 }",
    "mod_count": "SELECT COUNT ?o WHERE { ?o :hasPart ?p . ?p :suppliedBy ?s . ?s :suppNation nation:15 }",
    "mod_reduced": "SELECT REDUCED ?n WHERE { ?c :inNation ?n . ?n :inRegion region:1 }",
    "mod_duplicates": "SELECT DUPLICATES ?r WHERE { ?c :inNation ?n . ?n :inRegion ?r }",
    "filter_eq": 'SELECT ?p ?b WHERE { ?p :brand ?b . FILTER(?b = "Brand#13") }',
    "filter_ne": 'SELECT ?p ?t WHERE { ?p :ptype ?t . FILTER(?t != "ECONOMY") }',
    "filter_lt": "SELECT ?p ?z WHERE { ?p :size ?z . FILTER(?z < 5) }",
    "filter_le": "SELECT ?p ?z WHERE { ?p :size ?z . FILTER(?z <= 5) }",
    "filter_gt": 'SELECT ?s ?m WHERE { ?s :suppNation ?n . ?s :label ?m . FILTER(?m > "Supplier#000000005") }',
    "filter_ge": "SELECT ?p ?z WHERE { ?p :size ?z . FILTER(?z >= 48 && ?z < 50) }",
    "filter_var": "SELECT ?a ?b WHERE { ?a :inRegion ?r . ?b :inRegion ?r . FILTER(?a != ?b) }",
    "sugar": 'SELECT ?p ?l WHERE { ?p :ptype "ECONOMY" ; :brand "Brand#13" ; :label ?l . order:201 :hasPart ?q , ?r }',
}

DOCUMENTS = {
    "optional_left": "SELECT ?d ?l ?q WHERE { ?d :lang ?l . OPTIONAL { ?d :quality ?q } }",
    "optional_filter": "SELECT ?d ?q ?t WHERE { ?d :lang \"fr\" . OPTIONAL { ?d :quality ?q . FILTER(?q > 0) } OPTIONAL { ?d :toxic ?t } }",
    "path_turns": "SELECT ?a ?c ?r WHERE { ?a :nextTurn ?b . ?b :nextTurn ?c . ?c :role ?r }",
}

_GRAPHS = {id(EVENT): tables.event_graph, id(COMMERCE): tables.commerce_graph, id(DOCUMENTS): tables.document_graph}
_COMMERCE = {predicate(c.name) for c in tables.COMMERCE}
_EVENTS = {predicate(f"next_{t}") for t in tables.EVENT_TYPES}
_DOCUMENTS = {predicate(c.name) for c in tables.DOCUMENTS} | {predicate("nextTurn")}
_EDGES = {id(EVENT): _EVENTS, id(COMMERCE): _COMMERCE, id(DOCUMENTS): _DOCUMENTS}


def _text(text: str, group: dict[str, str], **options) -> Query:
    return lambda spark, d: run_query(_GRAPHS[id(group)](spark, d), PREFIXES + text, **options)


def _sql(text: str, group: dict[str, str]) -> str:
    return to_sql(PREFIXES + text, tables.edge_sql(_EDGES[id(group)].__contains__))


def _commerce(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, d: f(tables.commerce_graph(spark, d))


ORDER_201, NATION_2, PART = "<http://example.org/order/201>", "<http://example.org/nation/2>", predicate("hasPart")


def _candidates(g: Graph) -> DataFrame:
    """What ?a may be in the triangle, before anything is joined."""
    return first_values([g.subjects(predicate("next_click")), g.objects(predicate("next_purchase"))])


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def _escapes(spark: SparkSession, d: str) -> DataFrame:
    """Each document source and language beside accents and pictures, escaped and back."""
    docs = tables._table(spark, d, "documents").select("lang", "source").distinct()
    term = F.concat(F.lit('"é \U0001f600 '), "lang", F.lit(" ñ "), "source", F.lit('"'))
    return docs.select(term.alias("term")).select("term", escape_nt(F.col("term")).alias("escaped"), unescape_nt(escape_nt(F.col("term"))).alias("back"))


def _round_trip(spark: SparkSession, d: str, predicates: list[str] | None) -> DataFrame:
    from tessera.sources.ntriples import InvalidTriples, read_triples, validate, write_triples

    path = f"{fs.scratch(spark, 'triples')}.nt"
    write_triples(tables.commerce_graph(spark, d).triples(predicates), path, ascii_only=True)
    judged = validate(spark, path)
    if not judged.ok:
        raise InvalidTriples(judged.error)
    return read_triples(spark, path)


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Five predicates of the commerce graph written as N-Triples, validated, and read again."""
    return _round_trip(spark, d, [predicate(p) for p in ("inNation", "inRegion", "label", "segment", "size")])


def _roundtrip_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole commerce graph written as N-Triples, validated, and read again."""
    return _round_trip(spark, d, None)


_STORED: dict[tuple[str, str, int], str] = {}


def _over_stored(text: str, group: dict[str, str]) -> Query:
    """A query over the graph of a group, saved as a database and opened again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        key = spark.sparkContext.applicationId, d, id(group)
        if key not in _STORED:
            path = fs.scratch(spark, "graph")
            store.save(_GRAPHS[id(group)](spark, d).triples(), path)
            _STORED[key] = path
        return run_query(store.open_graph(spark, _STORED[key]), PREFIXES + text)

    return run


STORED = {
    "stored_full_scan": ("SELECT ?s ?p ?o WHERE { ?s ?p ?o }", COMMERCE),
    "stored_p_of_so": ("SELECT ?p WHERE { <http://example.org/nation/0> ?p <http://example.org/region/0> }", COMMERCE),
    "stored_po_of_s": ("SELECT ?p ?o WHERE { <http://example.org/order/201> ?p ?o }", COMMERCE),
    "stored_path": ("SELECT ?o ?n ?p WHERE { ?o :placedBy ?c . ?c :inNation ?n . ?n ?p <http://example.org/region/0> }", COMMERCE),
    "stored_self_loop": ("SELECT ?a ?p WHERE { ?a ?p ?a }", EVENT),
    "stored_two_predicates": ("SELECT ?a ?p ?c WHERE { ?a :next_click ?b . ?b ?p ?c . ?c :next_click ?a }", EVENT),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for group in (EVENT, COMMERCE, DOCUMENTS):
        out |= {k: _text(t, group) for k, t in group.items()}
    out |= {
        "bgp_full_scan": _commerce(lambda g: run_query(g, "SELECT ?s ?p ?o WHERE { ?s ?p ?o }")),
        "wcoj_triangle": _text(EVENT["bgp_Tr1"], EVENT, strategy="intersect"),
        "wcoj_square": _text(EVENT["bgp_S1"], EVENT, strategy="intersect"),
        "ix_subjects_of_p": _commerce(lambda g: g.subjects(PART)),
        "ix_objects_of_p": _commerce(lambda g: g.objects(PART)),
        "ix_preds_of_s": _commerce(lambda g: g.predicates_of_subject(ORDER_201)),
        "ix_preds_of_o": _commerce(lambda g: g.predicates_of_object(NATION_2)),
        "ix_objects_of_sp": _commerce(lambda g: g.objects_of(ORDER_201, PART)),
        "ix_subjects_of_op": _commerce(lambda g: g.subjects_of(NATION_2, predicate("inNation"))),
        "ix_preds_of_so": _commerce(lambda g: g.predicates_between("<http://example.org/nation/0>", "<http://example.org/region/0>")),
        "ix_objects_of_s": _commerce(lambda g: g.all_objects(ORDER_201)),
        "ix_subjects_of_o": _commerce(lambda g: g.all_subjects(NATION_2)),
        "stats_per_predicate": _commerce(Graph.predicate_stats),
        "stats_degrees": _commerce(lambda g: g.degrees("s").withColumn("role", F.lit("s")).unionByName(g.degrees("o").withColumn("role", F.lit("o")))),
        "stats_database": _commerce(Graph.database_stats),
        "stats_characteristic_sets": _commerce(lambda g: g.characteristic_sets().select(F.array_join("predicates", " ").alias("predicates"), "entities")),
        "stats_characteristic_set_of": _commerce(lambda g: g.characteristic_set_of(ORDER_201).select(F.array_join("predicates", " ").alias("predicates"))),
        "dict_roles": _commerce(Graph.roles),
        "dict_ids": _commerce(Graph.dictionary),
        "j_intersect_k": lambda s, d: intersect_sets([(g := tables.event_graph(s, d)).subjects(predicate("next_click")), g.objects(predicate("next_error")), g.subjects(predicate("next_purchase")), g.objects(predicate("next_view"))]),
        "j_first_variable": lambda s, d: _candidates(tables.event_graph(s, d)),
        "limit_n": lambda s, d: _counted(_text("SELECT ?o ?p WHERE { ?o :hasPart ?p } LIMIT 17", COMMERCE)(s, d)),
        "limit_cartesian": lambda s, d: _counted(_text("SELECT * WHERE { ?o :hasPart ?p . ?n :inRegion ?r } LIMIT 1000", COMMERCE)(s, d)),
        "limit_zero": _text("SELECT ?o WHERE { ?o :hasPart ?p } LIMIT 0", COMMERCE),
        "limit_distinct": lambda s, d: _counted(_text("SELECT DISTINCT ?n WHERE { ?c :inNation ?n } LIMIT 20", COMMERCE)(s, d)),
        "limit_display_cap": lambda s, d: capped(_text(COMMERCE["wd_S3"], COMMERCE)(s, d)),
        "result_stats": lambda s, d: result_stats(_text(COMMERCE["wd_S3"], COMMERCE)(s, d)),
        "result_stats_unbound": lambda s, d: result_stats(_text(DOCUMENTS["optional_left"], DOCUMENTS)(s, d)),
        "unicode_escape": _escapes,
        "nt_roundtrip": _roundtrip,
        "nt_roundtrip_whole": _roundtrip_whole,
    } | {k: _over_stored(t, group) for k, (t, group) in STORED.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in (EVENT, COMMERCE, DOCUMENTS):
        out |= {k: _sql(t, group) for k, t in group.items()}
    commerce = triples_cte(tables.edge_sql(_COMMERCE.__contains__))
    events = triples_cte(tables.edge_sql(_EVENTS.__contains__))
    some = triples_cte(tables.edge_sql({predicate(p) for p in ("inNation", "inRegion", "label", "segment", "size")}.__contains__))
    p = predicate
    sets = "SELECT s, string_agg(p, ' ' ORDER BY p) AS predicates FROM (SELECT DISTINCT s, p FROM triples) GROUP BY s"
    roles = "roles AS (SELECT term, CASE WHEN bool_or(r = 's') AND bool_or(r = 'o') THEN 'shared' WHEN bool_or(r = 's') THEN 'subject' ELSE 'object' END AS role FROM (SELECT s AS term, 's' AS r FROM triples UNION ALL SELECT o, 'o' FROM triples) GROUP BY term)"
    s3 = _sql(COMMERCE["wd_S3"], COMMERCE)
    out |= {
        "bgp_full_scan": f"{commerce} SELECT s, p, o FROM triples",
        "wcoj_triangle": out["bgp_Tr1"],
        "wcoj_square": out["bgp_S1"],
        "ix_subjects_of_p": f"{commerce} SELECT DISTINCT s FROM triples WHERE p = '{PART}'",
        "ix_objects_of_p": f"{commerce} SELECT DISTINCT o FROM triples WHERE p = '{PART}'",
        "ix_preds_of_s": f"{commerce} SELECT DISTINCT p FROM triples WHERE s = '{ORDER_201}'",
        "ix_preds_of_o": f"{commerce} SELECT DISTINCT p FROM triples WHERE o = '{NATION_2}'",
        "ix_objects_of_sp": f"{commerce} SELECT o FROM triples WHERE s = '{ORDER_201}' AND p = '{PART}'",
        "ix_subjects_of_op": f"{commerce} SELECT s FROM triples WHERE o = '{NATION_2}' AND p = '{p('inNation')}'",
        "ix_preds_of_so": f"{commerce} SELECT p FROM triples WHERE s = '<http://example.org/nation/0>' AND o = '<http://example.org/region/0>'",
        "ix_objects_of_s": f"{commerce} SELECT DISTINCT o FROM triples WHERE s = '{ORDER_201}'",
        "ix_subjects_of_o": f"{commerce} SELECT DISTINCT s FROM triples WHERE o = '{NATION_2}'",
        "stats_per_predicate": f"{commerce} SELECT p, count(*)::BIGINT AS edges, count(DISTINCT s)::BIGINT AS subjects, count(DISTINCT o)::BIGINT AS objects FROM triples GROUP BY p",
        "stats_degrees": f"{commerce} SELECT s AS term, count(*)::BIGINT AS degree, 's' AS role FROM triples GROUP BY s UNION ALL SELECT o, count(*)::BIGINT, 'o' FROM triples GROUP BY o",
        "stats_database": f"{commerce}, {roles} SELECT count(*) FILTER (role = 'subject') AS subject_count, count(*) FILTER (role = 'object') AS object_count, count(*) FILTER (role = 'shared') AS shared_count, count(*) AS entity_count, (SELECT count(DISTINCT p) FROM triples) AS predicate_count, (SELECT count(*) FROM triples)::BIGINT AS triple_count FROM roles",
        "stats_characteristic_sets": f"{commerce} SELECT predicates, count(*)::BIGINT AS entities FROM ({sets}) GROUP BY predicates",
        "stats_characteristic_set_of": f"{commerce} SELECT predicates FROM ({sets}) WHERE s = '{ORDER_201}'",
        "dict_roles": f"{commerce}, {roles} SELECT term, role FROM roles",
        "dict_ids": f"{commerce}, {roles} SELECT term, role, row_number() OVER (ORDER BY CASE role WHEN 'shared' THEN 0 WHEN 'subject' THEN 1 ELSE 2 END, term) AS id FROM roles",
        "j_intersect_k": f"{events} SELECT s AS value FROM triples WHERE p = '{p('next_click')}' INTERSECT SELECT o FROM triples WHERE p = '{p('next_error')}' INTERSECT SELECT s FROM triples WHERE p = '{p('next_purchase')}' INTERSECT SELECT o FROM triples WHERE p = '{p('next_view')}'",
        "j_first_variable": f"{events} SELECT s AS value FROM triples WHERE p = '{p('next_click')}' INTERSECT SELECT o FROM triples WHERE p = '{p('next_purchase')}'",
        "limit_n": f"SELECT count(*) AS rows FROM ({_sql('SELECT ?o ?p WHERE { ?o :hasPart ?p } LIMIT 17', COMMERCE)})",
        "limit_cartesian": f"SELECT count(*) AS rows FROM ({_sql('SELECT * WHERE { ?o :hasPart ?p . ?n :inRegion ?r } LIMIT 1000', COMMERCE)})",
        "limit_zero": _sql("SELECT ?o WHERE { ?o :hasPart ?p } LIMIT 0", COMMERCE),
        "limit_distinct": f"SELECT count(*) AS rows FROM ({_sql('SELECT DISTINCT ?n WHERE { ?c :inNation ?n } LIMIT 20', COMMERCE)})",
        "limit_display_cap": f'SELECT count(*) AS "count", least(count(*), 1000) AS returned_count, count(*) > 1000 AS truncated FROM ({s3})',
        "result_stats": f"SELECT count(*) AS rows, 3 * count(*) AS cells, 3 * count(*) AS filled, sum(strlen(p) + strlen(l) + strlen(s))::BIGINT AS chars, 100.0::DOUBLE AS filled_percent, round(sum(strlen(p) + strlen(l) + strlen(s)) / (3 * count(*)), 2) AS mean_chars FROM ({s3})",
        "result_stats_unbound": f"SELECT count(*) AS rows, 3 * count(*) AS cells, count(d) + count(l) + count(q) AS filled, sum(n)::BIGINT AS chars, round(100.0 * (count(d) + count(l) + count(q)) / (3 * count(*)), 2)::DOUBLE AS filled_percent, round(sum(n) / (3 * count(*)), 2) AS mean_chars FROM (SELECT *, strlen(coalesce(d, '')) + strlen(coalesce(l, '')) + strlen(coalesce(q, '')) AS n FROM ({_sql(DOCUMENTS['optional_left'], DOCUMENTS)}))",
        "unicode_escape": r"""SELECT t AS term, '"\u00E9 \uD83D\uDE00 ' || lang || ' \u00F1 ' || source || '"' AS escaped, t AS back FROM (SELECT DISTINCT lang, source, '"é 😀 ' || lang || ' ñ ' || source || '"' AS t FROM documents)""",
        "nt_roundtrip": f"{some} SELECT s, p, o FROM triples",
        "nt_roundtrip_whole": f"{commerce} SELECT s, p, o FROM triples",
    } | {k: _sql(t, group) for k, (t, group) in STORED.items()}
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation: a path of two."""
    return run_query(tables.commerce_graph(spark, sf_dir), PREFIXES + "SELECT ?o ?c ?n WHERE { ?o :placedBy ?c . ?c :inNation ?n }")
