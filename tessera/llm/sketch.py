"""Document fingerprints: bottom-k sketches of shingle hashes.

Words are lower-cased; a shingle is ``width`` words in a row (fewer words: the whole sequence),
its hash the XXH64 of its words' XXH64s. The sketch is the ``k`` smallest different hashes, of
which 48 bits are kept: eight base64 letters each, in rising order. Sketches are mergeable: the
sketch of a union is the k smallest of both. Two sketches estimate resemblance (share of the k
smallest of the union that both hold), containment and the number of different shingles.

Everything is DataFrame functions: the hashes of a text are made within one row, the next
document is found by windows inside ranges of doc_id, as many as the documents need.

Defined results: null text is empty; without words the sketch is empty (two such documents are
alike with 1, one such and another with 0); documents stand in falling order of doc_id, null
last, rows with equal doc_id by content; the only document of a table is its own next; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.llm.common import WORD_GAP, broadcast_if_small, stored

#: Hashes keep this many bits: positive longs.
BITS = 48


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP, -1), lambda w: w != "")


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """48-bit hashes of all shingles, repeats included; empty without words."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        rolled = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(width))), 64 - BITS))
        # few words: one shingle of them all
        whole = F.array(F.shiftrightunsigned(F.xxhash64(*(F.get(h, F.lit(j)) for j in range(width))), 64 - BITS))
        return F.when(n >= width, rolled).when(n > 0, whole).otherwise(F.slice(whole, 1, 0))

    # the word hashes are bound once, as the only element that is transformed
    return F.transform(F.array(hashed), of)[0]


def bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int) -> Column:
    """Sketch of the union of two shingle sets from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated Jaccard likeness, exact for sketches that hold all hashes."""

    def of(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        m = merge(x, y, k)
        both = F.size(F.array_intersect(F.array_intersect(x, y), m))
        return F.when(F.size(m) == 0, F.lit(1.0)).otherwise(both / F.size(m))

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of)[0]


def distinct_count(a: Column, k: int) -> Column:
    """Estimated number of different shingles: (k - 1) over the k-th smallest hash as a share of
    all; the number held where the sketch is not full."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated share of a's shingles that b has too."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def encode(a: Column) -> Column:
    """Text of a sketch: base64 of its 6-byte hashes."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))), "\r\n", "")


def _ranged(rows: DataFrame, rows_per_range: int, coarse: int) -> DataFrame:
    """``rows`` (doc_id, text, h) with the range (``q, sub``) that each is in; ranges stand in the
    order of documents. The driver gathers ``coarse`` borders at most, values of doc_id that
    occur, which cut the rows into parts; a part is cut evenly, by doc_id, or by the hash of the
    text where it holds a single doc_id or none."""
    n, least, most = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if most is None:
        return rows.withColumn("q", F.lit(0)).withColumn("sub", _share(F.col("h"), -(-n // rows_per_range)))
    parts = max(1, min(coarse, n // rows_per_range))
    found = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    single = {v for v in found if found.count(v) > 1}  # enough rows for a border more than once
    borders = sorted({v for v in (*found, *(v - 1 for v in single), most) if least <= v <= most})
    lower = [least - 1, *borders[:-1]]
    rank = _rank(F.col("doc_id"), borders[:-1])
    at = lambda values: F.element_at(F.lit([float(v) for v in values]), rank + 1)
    even = max(1, -(-n // (parts * rows_per_range)))
    place = (at(borders) - F.col("doc_id").cast("double")) / (at(borders) - at(lower)) * even
    place = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(even - 1)).cast("long")
    by_text = F.col("doc_id").isNull() | F.col("doc_id").isin(sorted(single)) if single else F.col("doc_id").isNull()
    sub = F.when(by_text, _share(F.col("h"), -(-n // rows_per_range))).otherwise(place)
    return rows.withColumn("q", F.when(F.col("doc_id").isNull(), len(borders)).otherwise(len(borders) - 1 - rank).cast("int")).withColumn("sub", sub)


def _share(h: Column, shares: int) -> Column:
    return F.least(F.floor((h.cast("double") / float(1 << 64) + 0.5) * max(1, shares)), F.lit(max(1, shares) - 1)).cast("long")


def with_next(docs: DataFrame, rows_per_range: int = 2_000, coarse: int = 1024, broadcast_rows: int = 100_000) -> tuple[DataFrame, WindowSpec]:
    """(doc_id, text, ghost, next_text): each document with the text of the one after it, and the
    window in which ``lead`` finds what else is wanted of that one. Rows marked ``ghost`` are
    copies that only serve as the next of a range's last row; drop them after use.

    Documents are cut into ranges of about ``rows_per_range``, however many they are, and each is
    a window of its own. The first row of a range is also sent to the range before it. What the
    driver gathers is a row for each of the ``coarse`` parts at most.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _ranged(rows.withColumn("h", F.xxhash64("text")), rows_per_range, coarse)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.expr("~doc_id").alias("down"), "h")
    firsts = stored(rows.groupBy("q", "sub").agg(F.min(key).alias("key")), "sketch-firsts")
    last_of = {r["q"]: r["last"] for r in firsts.groupBy("q").agg(F.max("sub").alias("last")).collect()}
    qs = sorted(last_of)
    before = {q: (qs[i - 1], last_of[qs[i - 1]]) for i, q in enumerate(qs)}  # the first follows the last
    own = F.lag("sub").over(Window.partitionBy("q").orderBy("sub"))
    place = [(q, *before[q]) for q in qs]
    place = docs.sparkSession.createDataFrame(place, "q int, other_q int, other_sub long")
    firsts = firsts.withColumn("own", own).join(F.broadcast(place), "q")
    to = F.when(F.col("own").isNotNull(), F.struct(F.col("q"), F.col("own").alias("sub"))).otherwise(F.struct(F.col("other_q").alias("q"), F.col("other_sub").alias("sub")))
    firsts = firsts.select(to.alias("to"), "key")
    firsts = broadcast_if_small(stored(firsts.groupBy("key").agg(F.first("to").alias("to")), "sketch-borders"), broadcast_rows)
    spots = F.filter(F.array(F.struct("q", "sub", F.lit(False).alias("ghost")), F.struct("to.q", "to.sub", F.lit(True).alias("ghost"))), lambda s: s["q"].isNotNull())
    dealt = rows.withColumn("key", key).join(firsts, "key", "left").withColumn("spot", F.explode(spots)).select("doc_id", "text", "h", "spot.q", "spot.sub", "spot.ghost")
    order = Window.partitionBy("q", "sub").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def _rank(value: Column, borders: list[int]) -> Column:
    """Number of borders below the value."""
    if len(borders) <= 8:
        return sum((F.when(value > b, 1).otherwise(0) for b in borders), F.lit(0))
    mid = len(borders) // 2
    return F.when(value > borders[mid], mid + 1 + _rank(value, borders[mid + 1 :])).otherwise(_rank(value, borders[:mid]))


def edited(text: Column, following: Column) -> Column:
    """The text, its last floor(n/2) code points replaced by the first as many of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def report(docs: DataFrame, k: int = 256, width: int = 5) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are found."""
    rows, order = with_next(docs)
    sketch = lambda c: bottom(shingle_hashes(F.col(c), width), k)
    rows = rows.withColumn("a", sketch("text")).withColumn("n", F.lead("a").over(order)).filter("NOT ghost")
    rows = rows.select("doc_id", "a", "n", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.select("doc_id", "a", "n", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch("edited").alias("e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", encode(F.col("a")).alias("fingerprint"), encode(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("e"), k).alias("near_edited"), resemblance(F.col("a"), F.col("n"), k).alias("near_next"), distinct_count(F.col("a"), k).alias("n_shingles"))
