"""Query on the Merkle manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.llm.common import table
from motes.llm.merkle import folded, leaf_digest, manifest
from motes.llm.registry import query

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

_H = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = " || ".join(_H.format(f"CAST({c} AS VARCHAR)") for c in COLUMNS)
_FORGED = " || ".join(_H.format(f"CAST({c} AS VARCHAR)") for c in ["doc_id", "source", "lang", "(CAST(n_chars AS HUGEINT) + 1)", "text"])
# the remainder register of CRC-32, bit by bit: a byte goes in, then eight steps
CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
  WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf, CASE WHEN {CRC.format("doc_id")} % 7 = 0 THEN sha256({_FORGED}) END AS forged,
         row_number() OVER () AS rid
  FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
         count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (
  SELECT coalesce('+' || lang, '') AS g, 0 AS k, p, n, leaf AS h FROM l
  UNION ALL
  SELECT g, k + 1, p // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY p)) FROM up WHERE n > 1 GROUP BY g, k, p // 2),
sub AS (
  SELECT g, k AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS k, p, n, subroot AS h FROM sub
  UNION ALL
  SELECT k + 1, p // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY k, p // 2),
way AS (
  SELECT l.rid, up.k, up.h, up.p % 2 AS side
  FROM l JOIN up ON up.g = coalesce('+' || l.lang, '') AND up.p = xor(l.p >> up.k, 1) AND up.n > 1
  UNION ALL
  SELECT l.rid, sub.height + top.k, top.h, top.p % 2
  FROM l JOIN sub ON sub.g = coalesce('+' || l.lang, '') JOIN top ON top.p = xor(sub.p >> top.k, 1) AND top.n > 1),
proof AS (SELECT rid, sha256(string_agg(h, '' ORDER BY k)) AS proof_sha256 FROM way GROUP BY rid),
height AS (
  SELECT l.rid, sub.subroot, sub.height + (SELECT max(k) FROM top) AS levels, coalesce(l.forged, l.leaf) AS start
  FROM l JOIN sub ON sub.g = coalesce('+' || l.lang, '')),
f AS (
  SELECT rid, levels, 0 AS k, start AS h FROM height
  UNION ALL
  SELECT f.rid, f.levels, f.k + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN w.side = 0 THEN w.h || f.h ELSE f.h || w.h END)
  FROM f LEFT JOIN way w ON w.rid = f.rid AND w.k = f.k WHERE f.k < f.levels),
r AS (SELECT h AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, height.subroot, r.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM l JOIN height USING (rid) LEFT JOIN proof USING (rid) JOIN f ON f.rid = l.rid AND f.k = f.levels CROSS JOIN r
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a changed one folds to."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    forged = leaf_digest([one_more if c == "n_chars" else F.col(c) for c in COLUMNS])
    marked = docs.withColumn("forged", F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, forged))
    proved = manifest(marked, COLUMNS, "lang", ["doc_id"], keep=["doc_id", "forged"]).withColumns(
        {"doc_id": F.col("row.doc_id"), "proof_sha256": F.sha2(F.concat_ws("", "siblings"), 256)}
    )
    checked = folded(proved, F.coalesce("row.forged", "digest"), ["doc_id", "digest", "subroot", "root", "proof_sha256"])
    return checked.select(
        "row.doc_id", F.col("row.digest").alias("leaf"), "row.subroot", "row.root", "row.proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("row.root")).alias("verified"),
    )
