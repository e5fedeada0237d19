"""Query on the prefix trie of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.llm.common import table
from motes.llm.prefix_trie import prefix_trie, turn_digests
from motes.llm.queries_merkle import CRC
from motes.llm.registry import query
from motes.session import checkpointed

# Conversations of one family open with the first turns of its first one, up to this many less one.
FAMILY = 20
HEADS = 4

OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, {{'r': role, 't': text}} AS said, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS p
  FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, {CRC.format("conv_id")} % {HEADS} AS h FROM t),
r AS (
  SELECT o.conv_id, p, said, words FROM o JOIN c USING (conv_id) WHERE p >= h
  UNION ALL
  SELECT c.conv_id, p, said, words FROM c JOIN o ON o.conv_id = c.base WHERE p < h),
l AS (
  SELECT c.conv_id, coalesce(list(said ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS path,
         coalesce(list(words ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS words
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
pre AS (
  SELECT conv_id, d, path[1:d] AS node, len(path) = d AS ends, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM l)),
n AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended
  FROM pre GROUP BY d, node),
k AS (SELECT d - 1 AS d, node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.node = n.node),
s AS (
  SELECT a AS d, node[1:a] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ended, '')) AS ends_sha256
FROM f JOIN s ON s.d = f.d AND s.node = f.node LEFT JOIN f p ON p.d = f.d - 1 AND p.node = f.node[1:f.d - 1]
"""


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of all conversations, each with the first turns of its family's first conversation for its own.

    A family has at most ``2 * FAMILY`` conversations and ``HEADS - 1`` turns to give, so the join adds few rows.
    """
    own = F.crc32(F.col("conv_id").cast("string")) % HEADS
    placed = turns.select("*", own.alias("own_from"))
    wanted = turns.select("conv_id").distinct().select("conv_id", own.alias("own_from"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    given = turns.filter((F.col("place") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = wanted.filter("own_from > 0").join(given, "base").filter("place < own_from")
    columns = ["conv_id", "place", "said", "words"]
    return placed.filter("place >= own_from").select(*columns).union(heads.select(*columns))


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt within their families."""
    turns = checkpointed(turn_digests(table(spark, sf_dir, "conversations")))
    return prefix_trie(rebuilt(turns), turns).drop("node")
