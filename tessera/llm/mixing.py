"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected to be taken ``rate = target / source size`` times. The
documents of a source stand in one order (size class, salt, size, doc_id); the prefix sum of
expected copies, shifted by one random offset per source, crosses an integer as often as the
document is emitted. Because the order is by size class, the words taken follow the target.

The prefix sum is taken in cells (source, size class, salt), so no task needs all rows of a
source; only the number of rows of each cell meets, and there are more salts where there are
more rows.

Targets are found by level: a source is full where ``cap`` times its size is below its weight
times the level, and the level is what is left over the weight that is left; it rises until no
source more is full. The driver sees two sums per step, however many sources there are.

Defined results: null text has size 0 and is taken 0 words; sources are ordered by code point
with null last; repeated rows are documents of their own; a null doc_id orders first; other columns
come back as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, numbered, size_in_words, stored, unfolded, whole_row

#: Weights of sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size, a document at most as many copies.
MAX_REPEAT = 3
#: Eight classes for each doubling of the size.
SIZE_CLASSES = 8 * 64


#: Rows for each salt, beyond the least number of salts.
SALT_ROWS = 100_000
LEAST_SALTS = 64


def size_class() -> Column:
    """Position of the top bit of ``size`` and the three bits after it, in integers."""
    bits = F.length(F.bin("size"))
    top = F.when(bits > 4, F.expr("shiftright(size, length(bin(size)) - 4)")).otherwise(F.expr("shiftleft(size, 4 - length(bin(size)))"))
    # never null, as the optimiser sees: a join on it adds no filter that counts words once more
    return F.coalesce(F.when(F.col("size") == 0, F.lit(-1)).otherwise((bits - 1) * 8 + top.cast("int") % 8).cast("int"), F.lit(-1))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, source_size; a stored table) with ``target``, the words to take from
    each: shares by weight of the total, none above ``cap`` times its size, the excess shared
    anew by weight until none is above."""
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.alias("w"), (cap * F.col("source_size").cast("double")).alias("most")), "mix-ranked")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        now = F.coalesce(F.col("most") / F.col("w") < F.lit(level), F.lit(False))
        held, left, n = ranked.agg(F.coalesce(F.sum(F.when(now, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~now, F.col("w"))), F.lit(0)), F.count(F.when(now, 1))).first()
        if n == full:
            break
        full, level = n, (total - held) / left if left else math.inf
    return ranked.select("source", "source_size", F.least(F.col("most"), F.col("w") * F.lit(level)).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1)."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, 8), 16, 10).cast("double") / float(2**32)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_REPEAT, seed: int = 17, carry: bool = True, size: Callable[[Column], Column] = size_in_words) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` of each document: how often the mix takes
    it. With ``carry``, ``row`` holds its columns; without, texts are not shuffled.

    Words are counted once for all sums, and once more for ``carry``, beside the texts.
    """
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size(F.col("text")).alias("size")]
    small = stored(docs.select(*own), "mix-sizes")
    per = stored(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    salts = max(LEAST_SALTS, -(-(per.agg(F.sum("n")).first()[0] or 0) // SALT_ROWS))
    want = targets(per.select("source", "source_size"), weights, cap)
    want = want.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset(F.col("source"), seed))
    # joins take the source with a letter before it, and one of its own for none
    named = lambda df: df.withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    salt = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("long") % salts, F.lit(-1)).cast("int")
    celled = lambda df: named(df).withColumn("class", size_class()).withColumn("salt", salt)
    cell = ["source", "class", "salt"]
    cells = stored(celled(small).groupBy(*cell).agg(F.count("*").alias("n")), "mix-cells")
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(upto("source", "class")), F.lit(0))).drop("n")
    cells = cells.withColumn("within", F.coalesce(F.sum("n").over(upto(*cell)), F.lit(0))).drop("n")
    cells = cells.join(classes, ["source", "class"]).join(broadcast_if_small(stored(named(want), "mix-targets"), 10_000), "source")
    cells = cells.withColumn("before", F.col("below") + F.col("within")).drop("below", "within")
    rows = celled(docs.select(whole_row(docs).alias("row"), *own, F.xxhash64("text").alias("tie")) if carry else small.withColumn("tie", F.lit(0)))
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", "tie")))
    at = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    rank = F.col("before") + F.col("no")
    joined = rows.join(cells, cell).withColumn("copies", (at(rank) - at(rank - 1)).cast("int"))
    return joined.select(*(["row"] if carry else []), "doc_id", "size", "source_size", "target", "copies")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    mixed = mix(docs, **options).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unfolded(mixed, "row", docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w,
             row_number() OVER (ORDER BY encode(source) NULLS LAST) AS ord FROM s),
f AS (SELECT *, coalesce(sum(3 * n) OVER o, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight
      FROM w WINDOW o AS (ORDER BY 3 * n / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT sum(n) FROM s) - filled) / weight)
             FILTER (((SELECT sum(n) FROM s) - filled) / weight <= 3 * n / w) AS level FROM f),
t AS (SELECT source, n, least(3 * n, w * level) AS target,
             ('0x' || left(md5('17|' || coalesce('s' || source, 'n')), 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM w, l),
r AS (
  SELECT d.doc_id, d.size, t.n::BIGINT AS source_size, t.target,
         CASE WHEN t.n = 0 THEN 0 ELSE t.target / t.n END AS rate, t.u,
         row_number() OVER (PARTITION BY d.source ORDER BY
           CASE WHEN size = 0 THEN -1 ELSE (length(bin(size)) - 1) * 8 + (CASE WHEN length(bin(size)) > 4
             THEN size >> (length(bin(size)) - 4) ELSE size << (4 - length(bin(size))) END) % 8 END,
           coalesce(('0x' || left(md5(doc_id::VARCHAR), 7))::BIGINT % z.salts, -1), size, doc_id NULLS FIRST) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source,
       (SELECT greatest(64, ceil(count(*) / 100000.0)::BIGINT) AS salts FROM d) z)
SELECT doc_id, size, source_size, target,
       (size * (floor(i * rate + u) - floor((i - 1) * rate + u)))::BIGINT AS taken
FROM r
"""
