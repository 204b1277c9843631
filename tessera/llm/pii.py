"""Personal data: patterns, and information-theoretic sanitisation around what they find.

Protected entities are the values that the patterns find (e-mail addresses, IP addresses, card
and phone numbers, and secrets: runs of 16 letters and digits or more, both mixed). A term (a lower-cased run of at least ``min_letters`` letters) that stands in
the same document as an entity may reveal it. Corpus co-occurrence says how strongly: with N
documents, C(e) of them with the entity, C(t) with the term and C(t, e) with both,

    information of e      I(e)   = log2(N / C(e))
    disclosure of e by t  PMI    = log2(N * C(t, e) / (C(t) * C(e)))
    disclosed share       PMI / I(e), 1 where t never stands without e

A term is generalised (kind ``term``) where the share reaches ``generalise``, and removed (kind
``drop``) where it reaches ``remove``. With a ``min_support`` over 1 it must stand beside e in so
many different texts, so copies of one text prove nothing; with 1, every pair is rated. Spans are
marked in the whole document that holds the entity.

Counts cover all documents. Equal texts are worked on once and count as often as they stand. A
term in more documents than the entities of its text allow is left out before pairs are made.
Entities that stand in the very same texts are rated as one, and so are terms that do and are in
as many documents: a text with thousands of both, all its own, makes one pair.
Terms are counted by exploding each document's distinct words; only sums per word are shuffled.

Positions are code points, from 0, end exclusive. Everything here is DataFrame functions.

Defined results: null text is empty; failing matches (an IP part over 255, a wrong check digit, a
wrong number of digits) are dropped without another try; rows that repeat get equal results; an
empty table gives no rows; other columns of sanitised rows come back whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, row_key, stored, unfolded, whole_row

#: The kinds of the contract come first.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4

# The patterns of the contract, with possessive quantifiers and look-behind where the leftmost
# match cannot differ: they keep long runs of letters or digits from being tried at each start.
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
#: What a text must hold for a pattern to be tried.
_HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": ""}
_WORDS = r"\p{L}+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass: from the right, every second doubled, digits of it summed."""
    back = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))
    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + x.cast("int")) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}\z")
    n = F.length(_digits(match))
    if kind == "secret":
        return (n >= 2) & (F.length(match) - n >= 2)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(match))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _matches(text: Column, pattern: str) -> Column:
    """What ``pattern`` finds, each with the length of what lies before it: (gap, value)."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.filter(F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("value")), lambda m: m["value"].isNotNull())


def _located(rows: DataFrame, found: str) -> DataFrame:
    """One row per match of column ``found``: ``start, end, value``, beside the other columns of
    ``rows``, which together tell texts apart; rows that repeat answer once. Lengths of what lies
    between matches and of the matches themselves are summed up along the text."""
    keep = [c for c in rows.columns if c != found]
    rows = rows.select(*keep, F.posexplode(found).alias("at", "m")).select(*keep, "at", F.col("m.gap").alias("gap"), F.col("m.value").alias("value")).distinct()
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy(*keep).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("at", "gap")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document, and a key of 128 bits for its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", *row_key("text"), "text")


def base_spans(keyed: DataFrame) -> DataFrame:
    """(rk1, rk2, kind, start, end, value) of all valid matches, each text's once."""
    marked = keyed.filter(F.col("text").rlike("[0-9@]"))
    text, tried = F.col("text"), []
    for no, kind in enumerate(KINDS):
        there = text.rlike(PATTERNS[kind])
        there = F.contains(text, F.lit(_HINTS[kind])) & there if _HINTS[kind] else there
        tried.append(F.struct(F.lit(no).alias("kind"), F.when(there, _matches(text, PATTERNS[kind])).alias("found")))
    each = marked.select("rk1", "rk2", F.explode(F.filter(F.array(*tried), lambda x: x["found"].isNotNull())).alias("x"))
    spans = _located(each.select("rk1", "rk2", F.col("x.kind").alias("kind"), F.col("x.found").alias("found")), "found")
    right = F.lit(False)
    for no, kind in reversed(list(enumerate(KINDS))):
        right = F.when(F.col("kind") == no, valid(kind, F.col("value"))).otherwise(right)
    return spans.filter(right).dropDuplicates(["rk1", "rk2", "kind", "start"])


def _words(held: DataFrame, min_letters: int) -> DataFrame:
    """(rk1, rk2, term, start, end) of the words that no entity of ``found`` overlaps."""
    words = _located(held.select("rk1", "rk2", _matches(F.col("text"), _WORDS).alias("word")), "word").filter(F.length("value") >= min_letters)
    words = words.select("rk1", "rk2", "start", "end", F.lower("value").alias("term"))
    marks = held.select("rk1", "rk2", F.explode("found").alias("f")).select("rk1", "rk2", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), F.lit(None).cast("string").alias("term"))
    # an entity that starts with or before a word and ends behind its start, or starts within it
    row = Window.partitionBy("rk1", "rk2")
    mark = F.col("term").isNull()
    upto = F.max(F.when(mark, F.col("end"))).over(row.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(mark, F.col("start"))).over(row.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = words.unionByName(marks).select("*", upto.alias("upto"), after.alias("after"))
    return both.filter("term IS NOT NULL AND NOT coalesce(upto > start, false) AND NOT coalesce(after < end, false)").drop("upto", "after")


def _texts_of() -> Column:
    """Which texts the rows of a group are of, by the keys of 128 bits: equal for equal sets. Each
    text must be there once."""
    return F.struct(F.bit_xor("rk1").alias("x1"), F.bit_xor("rk2").alias("x2"), F.count("*").alias("texts"))


def term_spans(keyed: DataFrame, spans: DataFrame, min_letters: int = 3, min_support: int = 3, generalise: float = 0.8, remove: float = 0.95, broadcast_rows: int = 200_000) -> DataFrame:
    """(rk1, rk2, kind, start, end) of terms that disclose an entity of their text."""
    total = float(max(keyed.count(), 1))
    per_row = spans.groupBy("rk1", "rk2").agg(F.collect_list(F.struct("start", "end", "kind", "value")).alias("found"))
    held = keyed.filter(F.col("text").rlike("[0-9@]")).join(per_row, ["rk1", "rk2"])
    held = held.select("rk1", "rk2", "found", "text").dropDuplicates(["rk1", "rk2"])
    words = stored(_words(held, min_letters), "pii-words")
    repeats = keyed.select("rk1", "rk2").join(spans.select("rk1", "rk2").distinct(), ["rk1", "rk2"], "left_semi").groupBy("rk1", "rk2").agg(F.count("*").alias("rows"))
    entities = stored(spans.select("rk1", "rk2", F.struct("kind", "value").alias("e")).distinct().join(repeats, ["rk1", "rk2"]), "pii-entities")
    n_e = stored(entities.groupBy("e").agg(F.sum("rows").alias("n_e"), _texts_of().alias("of")), "pii-n-e")
    vocabulary = keyed.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{min_letters},}}"), 0))).alias("term"))
    n_t = vocabulary.groupBy("term").agg(F.count("*").alias("n_t")).join(words.select("term").distinct(), "term")
    # C(t, e) is at most C(e): a term in more documents than this cannot reach ``generalise``
    entities = entities.join(n_e, "e").select("rk1", "rk2", F.col("of").alias("e"), "rows", "n_e").distinct()
    entities = stored(entities.withColumn("most", F.lit(total) * F.pow(F.col("n_e") / F.lit(total), F.lit(generalise)) * F.lit(1 + 1e-9)), "pii-rare")
    reach = entities.groupBy("rk1", "rk2").agg(F.max("most").alias("reach"))
    own = words.select("rk1", "rk2", "term").distinct().join(reach, ["rk1", "rk2"])
    own = own.join(stored(n_t, "pii-n-t").withColumnRenamed("term", "t"), (F.col("term") == F.col("t")) & (F.col("n_t") <= F.col("reach"))).select("rk1", "rk2", "term", "n_t")
    own = stored(own, "pii-own")
    alike = own.groupBy("term").agg(_texts_of().alias("of"), F.first("n_t").alias("n_t")).select("term", F.struct("of", "n_t").alias("t"))
    own = stored(own.join(alike, "term").select("rk1", "rk2", "term", "t"), "pii-alike")
    rare = own.select("rk1", "rk2", "t").distinct().join(entities, ["rk1", "rk2"]).filter(F.col("t.n_t") <= F.col("most"))
    rare = stored(rare.select("rk1", "rk2", "t", "e", "rows", F.col("t.n_t").alias("n_t"), "n_e"), "pii-pairs")
    information = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    rated = rare.groupBy("t", "e").agg(F.sum("rows").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.count("*").alias("texts")).filter(F.col("texts") >= min_support)
    rated = broadcast_if_small(stored(rated.select("t", "e", share.alias("share")).filter(F.col("share") >= generalise), "pii-rated"), broadcast_rows)
    told = rare.select("rk1", "rk2", "t", "e").join(rated, ["t", "e"]).groupBy("rk1", "rk2", "t").agg(F.max("share").alias("share"))
    hit = words.join(own.join(told, ["rk1", "rk2", "t"]).select("rk1", "rk2", "term", "share"), ["rk1", "rk2", "term"])
    return hit.select("rk1", "rk2", F.when(F.col("share") >= remove, len(KINDS) + 1).otherwise(len(KINDS)).alias("kind"), "start", "end")


NAMES = (*KINDS, "term", "drop")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(x) for x in NAMES))
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, rk1, rk2, spans) of each document; spans: array of (kind, start, end), ``kind``
    a position in ``NAMES``."""
    keyed = _keyed(docs)
    base = stored(base_spans(keyed), "pii-base")
    more = term_spans(keyed, base, **options)
    every = base.select("rk1", "rk2", "kind", "start", "end").unionByName(more)
    spans = every.groupBy("rk1", "rk2").agg(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")
    return keyed.select("doc_id", "rk1", "rk2").join(stored(spans, "pii-spans"), ["rk1", "rk2"], "left").select("doc_id", "rk1", "rk2", F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts per kind, digest of the patterns' spans, and all spans as text."""
    found = find(docs, **options)
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select(
        "doc_id", *(count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS[:BASE])),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        (count(len(KINDS)) + count(len(KINDS) + 1)).alias("n_terms"), count(BASE).alias("n_secret"),
    )


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with texts in which pattern matches became ``<EMAIL>`` and the like, generalised
    terms ``<TERM>``, and removed terms nothing. Overlapping spans: the one that starts first
    goes, the longer one at a tie."""
    found = find(docs, **options).select("rk1", "rk2", "spans").dropDuplicates(["rk1", "rk2"])
    keyed = docs.select(whole_row(docs, "text").alias("row"), F.col("text").cast("string").alias("text"), *row_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = keyed.join(found, ["rk1", "rk2"], "left")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    marks = F.array(*(F.lit(x) for x in ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<SECRET>", "<TERM>", "")))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        begin, end = s["start"], -s["end"]
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        return F.when(begin < acc["at"], acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], gap, F.element_at(marks, s["kind"] + 1)).alias("out")))

    done = F.aggregate(order, first, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return unfolded(rows, "row", docs.columns, text=F.coalesce(done, F.col("text")))
