"""Ready-made ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.operators import ranking, views
from motes.plans.registry import query
from motes.plans.standins import PARTICLES, VIEW_COUNT, VIEWS, particles, table, with_
from motes.session import checkpointed

RANKED = """layered AS (
  SELECT *, row_number() OVER (PARTITION BY half, view ORDER BY score DESC, _row) - 1 AS layer,
         max(score) OVER (PARTITION BY half, view) AS best,
         count(*) OVER (PARTITION BY half) AS total
  FROM grouped),
normed AS (
  SELECT *, CASE WHEN best > 0 AND layer > 0 THEN score / best ELSE score END AS norm FROM layered),
rnk AS (
  SELECT *, (row_number() OVER (PARTITION BY half ORDER BY layer, norm DESC, view) - 1) / CAST(total AS DOUBLE) AS rank
  FROM normed)"""

BY_HALF = "grouped AS (SELECT *, CASE WHEN subset = 1 THEN 1 ELSE 2 END AS half FROM placed)"
ONE_GROUP = "grouped AS (SELECT *, 1 AS half FROM placed)"


@query(
    "flagship_best_even_views",
    with_(PARTICLES, VIEWS, BY_HALF, RANKED, recursive=True)
    + """, optics AS (SELECT c_custkey, c_nationkey AS optics_group, n_name AS optics_name
                      FROM customer JOIN nation ON c_nationkey = n_nationkey),
    sel AS (SELECT *, row_number() OVER (ORDER BY rank, _row) AS pick FROM rnk)
    SELECT _row, subset, view, optics_name, round(rank, 9) AS rank
    FROM sel JOIN optics ON cust = c_custkey
    WHERE pick <= (SELECT count(*) // 2 FROM p)""",
)
def flagship(spark, sf_dir):
    p = particles(spark, sf_dir)
    n = p.count()
    ranked = ranking.equalised_rank(p, VIEW_COUNT, half="subset")
    # the selection looks at the ranks more than once
    ranked = checkpointed(ranked.select("_row", "subset", "view", "cust", "rank"))
    best = ranking.select_ranked(ranked, n // 2, by="rank")
    optics = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return best.join(optics, F.col("cust") == F.col("c_custkey")).select(
        "_row", "subset", "view", F.col("n_name").alias("optics_name"), F.round("rank", 9).alias("rank")
    )


MISSING = "placed AS (SELECT * REPLACE (CASE WHEN _row % 7 = 3 THEN NULL ELSE view END AS view) FROM seen)"


@query(
    "r3_missing_angles",
    with_(PARTICLES, VIEWS.replace("placed AS", "seen AS"), MISSING, "grouped AS (SELECT *, CASE WHEN subset = 1 THEN 1 ELSE 2 END AS half FROM placed WHERE view IS NOT NULL)", RANKED, recursive=True)
    + "SELECT p._row, rnk.view, layer, round(rank, 9) AS rank FROM p LEFT JOIN rnk USING (_row)",
)
def missing_angles(spark, sf_dir):
    """A particle without an angle keeps its row, has no rank, and does not count among the others."""
    p = particles(spark, sf_dir)
    some = {"rot": F.when(F.col("_row") % 14 != 3, F.col("rot")), "tilt": F.when(F.col("_row") % 14 != 10, F.col("tilt"))}
    ranked = ranking.equalised_rank(p.withColumns(some), VIEW_COUNT, half="subset")
    return ranked.select("_row", "view", "layer", F.round("rank", 9).alias("rank"))


@query("j17_nearest_view", with_(PARTICLES, VIEWS, recursive=True) + "SELECT _row, view FROM placed")
def nearest(spark, sf_dir):
    return views.nearest_view(particles(spark, sf_dir), VIEW_COUNT).select("_row", "view")


@query(
    "r2_layer_in_view",
    with_(PARTICLES, VIEWS, recursive=True)
    + "SELECT _row, view, row_number() OVER (PARTITION BY view ORDER BY score DESC, _row) - 1 AS layer FROM placed",
)
def layers(spark, sf_dir):
    placed = views.nearest_view(particles(spark, sf_dir), VIEW_COUNT)
    return ranking.layer_in_view(placed, ["view"]).select("_row", "view", "layer")


@query(
    "r3_equalised_rank",
    with_(PARTICLES, VIEWS, ONE_GROUP, RANKED, recursive=True) + "SELECT _row, view, round(rank, 9) AS rank FROM rnk",
)
def equalised(spark, sf_dir):
    return ranking.equalised_rank(particles(spark, sf_dir), VIEW_COUNT).select("_row", "view", F.round("rank", 9).alias("rank"))


@query(
    "r4_equalised_rank_by_half",
    with_(PARTICLES, VIEWS, BY_HALF, RANKED, recursive=True)
    + "SELECT _row, view, subset, round(rank, 9) AS rank FROM rnk",
)
def equalised_by_half(spark, sf_dir):
    return ranking.equalised_rank(particles(spark, sf_dir), VIEW_COUNT, half="subset").select(
        "_row", "view", "subset", F.round("rank", 9).alias("rank")
    )


@query(
    "r1_best_n",
    with_(PARTICLES)
    + """SELECT _row, score FROM p QUALIFY row_number() OVER (ORDER BY score, _row) <= 2000""",
)
def best_n(spark, sf_dir):
    return ranking.select_ranked(particles(spark, sf_dir).select("_row", "score"), 2000, by="score")


@query(
    "r1_worst_n",
    with_(PARTICLES)
    + """SELECT _row, score FROM p QUALIFY row_number() OVER (ORDER BY score DESC, _row) <= 2000""",
)
def worst_n(spark, sf_dir):
    return ranking.select_ranked(particles(spark, sf_dir).select("_row", "score"), 2000, by="score", worst=True)


@query(
    "r5_checkpoints",
    with_(PARTICLES)
    + """, o AS (SELECT class, subset, row_number() OVER (ORDER BY score, _row) AS rn FROM p),
    c AS (SELECT unnest([100, 500, 2500, 12500]) AS mark)
    SELECT CAST(mark AS BIGINT) AS checkpoint, class, subset, count(*) AS n FROM c JOIN o ON rn <= mark GROUP BY ALL""",
)
def checkpoints(spark, sf_dir):
    return ranking.checkpoint_counts(particles(spark, sf_dir), [100, 500, 2500, 12500], "score", ["class", "subset"])


@query(
    "r7_number_in_runs",
    with_(PARTICLES)
    + """, c AS (SELECT _row, stack, CASE WHEN stack = lag(stack) OVER (ORDER BY _row) THEN 0 ELSE 1 END AS new FROM p),
    g AS (SELECT *, sum(new) OVER (ORDER BY _row) AS run FROM c)
    SELECT _row, lpad(CAST(row_number() OVER (PARTITION BY run ORDER BY _row) AS VARCHAR), 8, '0') || '@' || stack AS image
    FROM g""",
)
def runs(spark, sf_dir):
    from motes.functions.keys import image_key

    numbered = ranking.number_in_runs(particles(spark, sf_dir).select("_row", "stack"), "stack")
    return numbered.select("_row", image_key(F.col("number"), F.col("stack"), 8).alias("image"))


@query(
    "r14_next_ids",
    """WITH old AS (SELECT max(c_custkey) AS m FROM customer)
    SELECT o_orderkey AS _row, m + row_number() OVER (ORDER BY o_orderkey) AS particle_id,
           'P' || lpad(CAST(m + row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 6, '0') AS particle_name
    FROM orders, old""",
)
def next_ids(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.format_string("P%06d", "c_custkey").alias("name"))
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"))
    return ranking.assign_ids(new, old)


@query(
    "r15_last_events",
    """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5""",
)
def tail(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session"))
    return ranking.last_rows(ev, ["session"], "seq", 5)
