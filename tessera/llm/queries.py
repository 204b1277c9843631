"""The registered query of each operator, over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, langid, linededup, mixing, packing, pii, simhash, sketch, suffixdedup, warc
from tessera.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every pair of a term and an entity is rated, those of one text too
    return pii.report(read_table(spark, sf_dir, "documents"), min_support=1)


def op2_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.report(read_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("label.doc_id").alias("component_id"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), carry=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), ann.every(100))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_report(read_table(spark, sf_dir, "documents"), equal_words=1)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (
  SELECT sha, array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)
      FOR i IN range(0, 32)], '') AS digest
  FROM (SELECT DISTINCT sha FROM p)),
g AS (SELECT sha, max(page_id) AS kept FROM p GROUP BY sha)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p JOIN d USING (sha) JOIN g USING (sha)
"""

#: Every string of 400 bytes, its digest, and the runs that repeated ones cover.
REPEATS_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 399]) AS m FROM t, unnest(range(1, octet_length(b) - 398)) AS u(i)),
s AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
r AS (SELECT doc_id, i, i - lag(i, 1, i - 401) OVER (PARTITION BY doc_id ORDER BY i) > 400 AS starts FROM s),
g AS (SELECT doc_id, i, count(*) FILTER (starts) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
e AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run),
k AS (
  SELECT doc_id, b, coalesce(lag(z) OVER own, 1) AS a, coalesce(e.a, octet_length(b) + 1) AS z, e.z - e.a AS lost
  FROM t LEFT JOIN (SELECT * FROM e UNION ALL SELECT DISTINCT doc_id, 9223372036854775807, NULL, NULL FROM e) e USING (doc_id)
  WINDOW own AS (PARTITION BY doc_id ORDER BY run))
SELECT doc_id, any_value(octet_length(b))::BIGINT AS n_bytes, coalesce(sum(lost), 0)::BIGINT AS n_removed, count(lost)::BIGINT AS n_spans,
       sha256(unhex(coalesce(string_agg(CASE WHEN z > a THEN hex(b[a:z - 1]) ELSE '' END, '' ORDER BY a), ''))) AS kept_sha256
FROM k GROUP BY doc_id
"""

#: Lines as lists of words; those that share a half with another are compared without a word each.
LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL)),
c AS (SELECT ws, array_to_string(ws, ' ') AS t, len(ws) AS n, min({'d': doc_id, 'no': no}) AS first FROM l WHERE len(ws) > 0 GROUP BY ws),
h AS (
  SELECT t, unnest([(n, 0, ws[1:n // 2]), (n, 1, ws[n // 2 + 1:]), (n - 1, 0, ws[1:(n - 1) // 2]), (n - 1, 1, ws[n - (n - 1 - (n - 1) // 2) + 1:])]) AS k
  FROM c WHERE n >= 5),
alive AS (SELECT * FROM c SEMI JOIN (SELECT t FROM h SEMI JOIN (SELECT k FROM h GROUP BY k HAVING count(DISTINCT t) > 1) USING (k)) USING (t)),
v AS (SELECT t, n, first, i, md5(array_to_string(ws[1:i - 1] || ws[i + 1:], ' ')) AS g FROM alive, unnest(range(1, n + 1)) AS u(i)),
replaced AS (SELECT v.t FROM v JOIN (SELECT n, i, g, min(first) AS least FROM v GROUP BY ALL) USING (n, i, g) WHERE least < first),
lacking AS (SELECT v.t AS more, v.first AS more_first, a.t AS less, a.first AS less_first FROM v JOIN alive a ON md5(a.t) = v.g AND a.n = v.n - 1),
near AS (SELECT t FROM replaced UNION SELECT more FROM lacking WHERE less_first < more_first UNION SELECT less FROM lacking WHERE more_first < less_first),
f AS (SELECT l.*, c.t IS NOT NULL AND (near.t IS NOT NULL OR c.first <> {'d': doc_id, 'no': no}) AS gone FROM l LEFT JOIN c USING (ws) LEFT JOIN near ON near.t = c.t)
SELECT doc_id, coalesce(count(no), 0)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       CASE WHEN any_value(d.text IS NOT NULL) THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) END AS kept_sha256
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""


def queries() -> dict[str, Query]:
    own = (op1_pii, op2_sketch, op3_langid, op4_simhash, op5_mixing, op6_packing, op7_ann, op8_linededup, op9_suffixdedup, op10_warc)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE, "op8_linededup": LINES_SQL, "op9_suffixdedup": REPEATS_SQL, "op10_warc": WARC_SQL}
