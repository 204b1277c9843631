"""N-Triples files as DataFrames (s, p, o) of terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.terms import escape_nt, unescape_nt

#: Subject, predicate, and the rest of the line up to the final dot.
LINE = r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$"
#: Non-blank lines, comments left out, that validation looks at.
SAMPLE_LINES = 100_000


class InvalidTriples(ValueError):
    """A file that is not N-Triples; says why and where."""


def _content(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))


def read_triples(spark: SparkSession, path: str, distinct: bool = True, seen: Observation | None = None) -> DataFrame:
    """Triples of one or more files; blank lines and comments are skipped, unicode escapes
    replaced. A graph is a set, so equal triples count once unless ``distinct`` is off. Lines that
    are no triple are left out; ``seen`` counts them (``rejected``) and all others (``read``)
    while the first action on the triples runs."""
    lines = _content(spark.read.text(path))
    if seen is not None:
        good = F.regexp_extract("value", LINE, 3) != ""
        lines = lines.observe(seen, F.count_if(good).alias("read"), F.count_if(~good).alias("rejected"))
    parts = [F.regexp_extract("value", LINE, i) for i in (1, 2, 3)]
    triples = lines.select(*(unescape_nt(x).alias(n) for x, n in zip(parts, "spo", strict=True))).filter("o != ''")
    return triples.dropDuplicates() if distinct else triples


def write_triples(triples: DataFrame, path: str, ascii_only: bool = False) -> None:
    """One statement per line. With ``ascii_only``, other characters are escaped."""
    text = (lambda c: escape_nt(F.col(c))) if ascii_only else F.col
    triples.select(F.concat_ws(" ", text("s"), text("p"), text("o"), F.lit(".")).alias("value")).write.text(path)


@dataclass(frozen=True)
class Validation:
    ok: bool
    checked: int
    error: str | None = None


def validate(spark: SparkSession, path: str, sample: int = SAMPLE_LINES) -> Validation:
    """Look at the first ``sample`` statements: each must end with a dot and have a subject, a
    predicate and an object; there must be one at least."""
    if not path.lower().endswith(".nt"):
        return Validation(False, 0, "only .nt files are accepted")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    first = _content(lines).limit(sample)
    trimmed = F.trim(F.regexp_replace("value", r"\s+$", ""))
    fault = F.when(~trimmed.endswith("."), "does not end with a dot").when(~F.col("value").rlike(LINE), "lacks a subject, a predicate or an object").when(F.regexp_extract("value", LINE, 3) == "", "has an empty object")
    judged = first.withColumn("fault", fault)
    n, bad = judged.agg(F.count("*"), F.min(F.when(F.col("fault").isNotNull(), F.struct("at", "fault", "value")))).first()
    if bad is not None:
        number = lines.filter(F.col("at") <= bad["at"]).count()
        return Validation(False, n, f"line {number} {bad['fault']}: {bad['value'][:120]}")
    return Validation(True, n) if n else Validation(False, 0, "no triple found")
