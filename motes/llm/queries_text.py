"""Queries on single documents and pages: quality rules, licences, URLs, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.llm.common import table
from motes.llm.license_scan import license_scan
from motes.llm.mixing import mixed
from motes.llm.personal_data import personal_data
from motes.llm.quality_rules import STOP_WORDS, quality_rules
from motes.llm.registry import query
from motes.llm.url_filter import url_filter

_STOP = ", ".join(f"'{x}'" for w in dict.fromkeys(STOP_WORDS) for x in (w, w.capitalize()))

OP1_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (
  SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] || ' ' || ws[p + 4] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
again AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
gaps AS (
  SELECT rid, least(5, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p) - p, 5)) AS gap FROM again),
rep AS (SELECT rid, sum(gap) AS n FROM gaps GROUP BY rid),
m AS (
  SELECT doc_id, t, ws, ls, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)),
r AS (
  SELECT *, nullif(n_words, 0) AS n, nullif(len(ls), 0) AS l FROM m),
q AS (
  SELECT *, 100.0 * n_repeat_words / n AS repeat_percent, n_symbols / n AS symbol_ratio,
    word_chars / n AS mean_word_length,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) / nullif(word_chars, 0) AS capital_ratio,
    1 - length(regexp_replace(t, '[A-Za-z\x{{80}}-\x{{10FFFF}}\x20\x09-\x0D]+', '', 'g')) / nullif(word_chars, 0) AS letter_ratio,
    CASE WHEN n_words >= 50 THEN len(list_filter(ws, lambda x: x IN ({_STOP}))) / n END AS stop_ratio,
    CASE WHEN l >= 10 THEN n_dup_lines / l END AS dup_line_ratio,
    CASE WHEN l >= 10 THEN len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) / l END AS bullet_ratio,
    CASE WHEN l >= 10 THEN len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) / l END AS ellipsis_ratio
  FROM r),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(symbol_ratio > 0.2, FALSE) AND NOT coalesce(mean_word_length < 2, FALSE)
  AND NOT coalesce(mean_word_length > 16, FALSE) AND NOT coalesce(capital_ratio > 0.4, FALSE)
  AND NOT coalesce(letter_ratio < 0.3, FALSE) AND NOT coalesce(stop_ratio < 0.02, FALSE)
  AND NOT coalesce(dup_line_ratio > 0.5, FALSE) AND NOT coalesce(bullet_ratio > 0.9, FALSE)
  AND NOT coalesce(ellipsis_ratio > 0.5, FALSE) AS kept
FROM v
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS full_at,
         (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
o AS (SELECT *, (SELECT arg_min(level, (full_at, coalesce(source, chr(1114111)))) FROM l WHERE full_at >= level) AS top FROM l),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(top * weight, 3.0::DOUBLE * source_size)) AS target FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


@query("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


# The rules of the query (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

OP4_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host = '' THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@query("op4_url_filter", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
