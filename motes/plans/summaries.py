"""Ready-made counting, grouping and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.functions import keys
from motes.operators import summaries
from motes.plans.registry import query
from motes.plans.standins import PARTICLES, particles, table, with_


def P(body: str) -> str:
    return with_(PARTICLES) + body


@query("a1_count_halves", P("SELECT count(*) AS n, count(*) FILTER (subset = 1) AS half1, count(*) FILTER (subset = 2) AS half2 FROM p"))
def count_halves(spark, sf_dir):
    return summaries.count_halves(particles(spark, sf_dir))


@query("a2_micrograph_counts", P("SELECT regexp_extract(mic, '[^/]*/[^/]*$') AS micrograph, count(*) AS n FROM p GROUP BY 1"))
def micrograph_counts(spark, sf_dir):
    return summaries.micrograph_counts(particles(spark, sf_dir), depth=1)


@query("a2_stack_counts", P("SELECT regexp_extract(stack, '[^/]*$') AS micrograph, count(*) AS n FROM p GROUP BY 1"))
def stack_counts(spark, sf_dir):
    p = particles(spark, sf_dir).select(keys.image_key(F.col("image_no"), F.col("stack")).alias("image"))
    return summaries.micrograph_counts(p, mic=None)


@query("a3_micrograph_coordinates", P("SELECT _row, mic, x, y, row_number() OVER (PARTITION BY mic ORDER BY _row) - 1 AS place FROM p"))
def micrograph_coordinates(spark, sf_dir):
    return summaries.micrograph_coordinates(particles(spark, sf_dir))


@query("a4_distinct_jobs", P("SELECT DISTINCT class, subset FROM p"))
def distinct_jobs(spark, sf_dir):
    return particles(spark, sf_dir).select("class", "subset").distinct()


@query("a5_first_of_key", P("SELECT _row, image_no, stack, score FROM p QUALIFY row_number() OVER (PARTITION BY image_no, stack ORDER BY _row) = 1"))
def first_of_key(spark, sf_dir):
    return summaries.first_of_key(particles(spark, sf_dir).select("_row", "image_no", "stack", "score"), ["image_no", "stack"])


FOLDERS = with_(PARTICLES) + """, f AS (SELECT *, regexp_replace(mic, '/[^/]*$', '') || '/' || CAST(class AS VARCHAR) AS folder FROM p),
g AS (SELECT folder, min(_row) AS r, arg_min(score, _row) AS voltage FROM f GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY r) AS id FROM g)
"""


def _folders(spark, sf_dir):
    p = particles(spark, sf_dir).withColumn("voltage", F.col("score"))
    folder = F.concat_ws("/", keys.directory(F.col("mic")), F.col("class").cast("string"))
    return summaries.optics_from_folders(p, folder, ["voltage"])


@query("a6_optics_from_folders", FOLDERS + "SELECT id AS optics_group, folder AS optics_name, voltage FROM o")
def optics_from_folders(spark, sf_dir):
    return _folders(spark, sf_dir)[0]


@query("a6_mapped_particles", FOLDERS + "SELECT _row, id AS optics_group FROM f JOIN o USING (folder)")
def mapped_particles(spark, sf_dir):
    return _folders(spark, sf_dir)[1].select("_row", "optics_group")


@query("a7_dense_stack_ids", P("SELECT mic AS key, min(_row) AS _row, row_number() OVER (ORDER BY min(_row)) AS id FROM p GROUP BY mic"))
def dense_ids(spark, sf_dir):
    return summaries.dense_ids(particles(spark, sf_dir), F.col("mic"))


def _two(spark, sf_dir):
    a = particles(spark, sf_dir).select("_row", "subset", "rot", "tilt", "psi", "x", "y")
    b = a.select("_row", (F.col("rot") + 3).alias("rot"), (F.col("tilt") + F.col("_row") % 5).alias("tilt"), (F.col("psi") - F.col("_row") % 7).alias("psi"), (F.col("x") * 1.25).alias("x"), (F.col("y") + 0.5).alias("y"))
    return a, b


DIFFS = with_(PARTICLES) + """, c AS (SELECT 0.01745329251 AS k), d AS (SELECT subset,
    degrees(sqrt((sin(tilt*k)*cos(rot*k) - sin((tilt + _row % 5)*k)*cos((rot+3)*k))**2 + (sin(tilt*k)*sin(rot*k) - sin((tilt + _row % 5)*k)*sin((rot+3)*k))**2 + (sin(tilt*k) - sin((tilt + _row % 5)*k))**2)) AS angle,
    sqrt((x - x*1.25)**2 + 0.25) AS origin, CAST(_row % 7 AS DOUBLE) AS psi FROM p, c),
  m AS (SELECT avg(angle) AS ma, avg(origin) AS mo, avg(psi) AS mp FROM d),
  s AS (SELECT subset AS half, count(*) AS n, avg(angle) AS a1, stddev_samp(angle) AS a2, avg(origin) AS o1, stddev_samp(origin) AS o2, avg(psi) AS p1, stddev_samp(psi) AS p2,
    sqrt(sum((angle-ma)**2)/(count(*)-1)) AS a3, sqrt(sum((origin-mo)**2)/(count(*)-1)) AS o3, sqrt(sum((psi-mp)**2)/(count(*)-1)) AS p3 FROM d, m GROUP BY ROLLUP (subset))
"""


@query(
    "a8_difference_statistics",
    DIFFS + "SELECT half, n, round(a1,6) AS angle_mean, round(a2,6) AS angle_sd, round(a3,6) AS angle_sd_global, round(o1,6) AS origin_mean, round(o2,6) AS origin_sd, round(o3,6) AS origin_sd_global, round(p1,6) AS psi_mean, round(p2,6) AS psi_sd, round(p3,6) AS psi_sd_global FROM s",
)
def difference_statistics(spark, sf_dir):
    stats = summaries.difference_statistics(*_two(spark, sf_dir))
    return stats.select("half", "n", *[F.round(c, 6).alias(c) for c in stats.columns if c not in ("half", "n")])


@query("a9_row_means", P("SELECT _row, round((rot + (rot + 3) + rot * 2) / 3, 6) AS rot, round((tilt + (tilt + _row % 5) + 0) / 3, 6) AS tilt FROM p"))
def row_means(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    third = a.select("_row", (F.col("rot") * 2).alias("rot"), F.lit(0.0).alias("tilt"))
    means = summaries.row_means([a, b, third], ["rot", "tilt"])
    return means.select("_row", F.round("rot", 6).alias("rot"), F.round("tilt", 6).alias("tilt"))


WRAPPED = """h AS (SELECT *, fmod(fmod((rot + 0.3) * pi() / 180, 2 * pi()) + 2 * pi(), 2 * pi()) - pi() AS a, fmod(fmod((tilt + 0.3) * pi() / 180, pi()) + pi(), pi()) - pi() / 2 AS b FROM p),
hb AS (SELECT _row, least(CAST(floor((a + 3.1415926535) / (2 * 3.1415926535 / 36)) AS BIGINT), 35) AS bin_x, least(CAST(floor((b + 1.570796) / (2 * 1.570796 / 36)) AS BIGINT), 35) AS bin_y
  FROM h WHERE abs(a) <= 3.1415926535 AND abs(b) <= 1.570796)"""


def _shifted(spark, sf_dir):
    return particles(spark, sf_dir).select("_row", (F.col("rot") + 0.3).alias("rot"), (F.col("tilt") + 0.3).alias("tilt"))


@query("a10_angle_histogram", with_(PARTICLES, WRAPPED) + "SELECT bin_x, bin_y, count(*) AS n FROM hb GROUP BY ALL")
def angle_histogram(spark, sf_dir):
    return summaries.angle_histogram(_shifted(spark, sf_dir), 36)


@query("a10_angle_bin_id", with_(PARTICLES, WRAPPED) + "SELECT p._row, bin_x + 36 * bin_y AS bin_id FROM p LEFT JOIN hb ON p._row = hb._row")
def angle_bin_id(spark, sf_dir):
    return summaries.angle_bin_id(_shifted(spark, sf_dir), 36).select("_row", "bin_id")


@query(
    "a8_angle_statistics",
    with_(PARTICLES) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, min({c}) AS min, max({c}) AS max, round(stddev_samp({c}), 6) AS sd FROM p" for c in ("rot", "tilt", "psi")),
)
def angle_statistics(spark, sf_dir):
    return summaries.column_statistics(particles(spark, sf_dir), ["rot", "tilt", "psi"]).select(
        "column", F.round("mean", 6).alias("mean"), "min", "max", F.round("sd", 6).alias("sd")
    )


CLASSED = """cl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount - 0.05 AS s_class1, CASE WHEN l_quantity < 5 THEN 'nan'::DOUBLE ELSE l_tax - 0.04 END AS s_class2, CASE WHEN l_linenumber <> 3 THEN 0.01 * (l_partkey % 3) - 0.01 END AS s_class3 FROM lineitem)"""


@query(
    "a34_best_class",
    with_(CLASSED)
    + """, g AS (SELECT *, greatest(s_class1, CASE WHEN isnan(s_class2) THEN NULL ELSE s_class2 END, s_class3) AS top FROM cl)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN top IS NULL OR top <= 0 THEN -1 WHEN s_class1 = top THEN 1 WHEN s_class2 = top THEN 2 ELSE 3 END AS INTEGER) AS class FROM g""",
)
def best_class(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_discount") - 0.05).alias("s_class1"),
        F.when(F.col("l_quantity") < 5, F.lit(float("nan"))).otherwise(F.col("l_tax") - 0.04).alias("s_class2"),
        F.when(F.col("l_linenumber") != 3, 0.01 * (F.col("l_partkey") % 3) - 0.01).alias("s_class3"),
    )
    return summaries.best_class(scored).drop("s_class1", "s_class2", "s_class3")


@query("a35_best_table", P("SELECT _row, CAST(CASE WHEN rot >= tilt AND rot >= y THEN 1 WHEN tilt >= y THEN 2 ELSE 3 END AS INTEGER) AS class FROM p"))
def best_table(spark, sf_dir):
    p = particles(spark, sf_dir)
    return summaries.best_table([p.select("_row", F.col(c).alias("score")) for c in ("rot", "tilt", "y")])
