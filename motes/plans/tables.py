"""Ready-made column, filter, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.functions import keys
from motes.operators import ordered, tables
from motes.plans.registry import query
from motes.plans.standins import PARTICLES, VOXELS, particles, table, voxels, with_


def P(body: str) -> str:
    return with_(PARTICLES) + body


@query("p1_keep_columns", P("SELECT tilt, rot, _row FROM p"))
def keep_columns(spark, sf_dir):
    return particles(spark, sf_dir).select("tilt", "rot", "_row")


@query("p2_drop_columns", P("SELECT * EXCLUDE (psi, mic, image_no, stack, x, y, cust) FROM p"))
def drop_columns(spark, sf_dir):
    return tables.drop_like(particles(spark, sf_dir), ["psi", "mic", "image_no", "stack", "x", "y", "cust"])


@query("p3_drop_prefix", "SELECT c_custkey, c_name FROM customer")
def drop_prefix(spark, sf_dir):
    return tables.drop_like(table(spark, sf_dir, "customer"), ["c_nation*", "c_acct*", "c_mktsegment"])


@query("p4_set_by_row", P("SELECT _row, rot, score, tilt + 1 AS tilt, tilt * 2 AS extra FROM p"))
def set_by_row(spark, sf_dir):
    p = particles(spark, sf_dir)
    other = p.select("_row", (F.col("tilt") + 1).alias("tilt"), (F.col("tilt") * 2).alias("extra"))
    return tables.set_by_row(p.select("_row", "rot", "tilt", "score"), other, ["tilt", "extra"])


@query("p5_constant_fill", P("SELECT _row, CAST(7 AS INTEGER) AS class, 'setA' AS label FROM p"))
def constant_fill(spark, sf_dir):
    return particles(spark, sf_dir).select("_row", F.lit(7).alias("class"), F.lit("setA").alias("label"))


@query("p6_number_rows", P("SELECT _row, _row + 1 AS number FROM p"))
def number_rows(spark, sf_dir):
    return tables.number_rows(particles(spark, sf_dir).select("_row"), "number")


@query("p7_swap_columns", P("SELECT _row, tilt AS rot, rot AS tilt FROM p"))
def swap_columns(spark, sf_dir):
    return tables.swap_columns(particles(spark, sf_dir).select("_row", "rot", "tilt"), "rot", "tilt")


@query("p8_backup_key", P("SELECT _row, lpad(CAST(image_no AS VARCHAR), 6, '0') || '@' || stack AS image, lpad(CAST(image_no AS VARCHAR), 6, '0') || '@' || stack AS backup FROM p"))
def backup_key(spark, sf_dir):
    image = keys.image_key(F.col("image_no"), F.col("stack"))
    return particles(spark, sf_dir).select("_row", image.alias("image")).withColumn("backup", F.col("image"))


@query("p9_multiply", P("SELECT _row, score * 0.5 AS score FROM p"))
def multiply(spark, sf_dir):
    return particles(spark, sf_dir).select("_row", (F.col("score") * 0.5).alias("score"))


@query("p10_default_columns", P("SELECT _row, subset, CAST(0.0 AS DOUBLE) AS phase_shift, CAST(1 AS INTEGER) AS body FROM p"))
def default_columns(spark, sf_dir):
    df = particles(spark, sf_dir).select("_row", "subset")
    return tables.fill_missing_columns(df, {"phase_shift": 0.0, "subset": 1, "body": 1})


@query("p11_project", P("SELECT score, CAST(NULL AS VARCHAR) AS figure, _row FROM p"))
def project(spark, sf_dir):
    return tables.project(particles(spark, sf_dir), ["score", "figure", "_row"])


@query("p12_trim_dimension", "SELECT c_custkey, c_acctbal, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def trim_dimension(spark, sf_dir):
    fact = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_acctbal", F.lit(0).alias("n_regionkey"))
    dim = tables.trim_dimension(table(spark, sf_dir, "nation"), fact, ["n_nationkey"])
    return fact.drop("n_regionkey").join(dim, "n_nationkey")


@query("f1_keep_equal_text", P("SELECT _row, class FROM p WHERE CAST(class AS VARCHAR) = '3'"))
def keep_equal(spark, sf_dir):
    return tables.keep_equal(particles(spark, sf_dir).select("_row", "class"), "class", 3)


@query("f1_keep_equal_number", P("SELECT _row, tilt FROM p WHERE tilt = 53"))
def keep_equal_number(spark, sf_dir):
    return tables.keep_equal(particles(spark, sf_dir).select("_row", "tilt"), "tilt", 53, numeric=True)


@query("f2_drop_equal", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def drop_equal(spark, sf_dir):
    return tables.drop_equal(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F")


@query("f3_keep_jobs", P("SELECT _row, class, subset FROM p WHERE class IN (1, 4) AND subset IN (2)"))
def keep_jobs(spark, sf_dir):
    return tables.keep_jobs(particles(spark, sf_dir).select("_row", "class", "subset"), [1, 4], [2])


@query("f4_split_halves", P("SELECT _row, CAST(subset AS INTEGER) AS part FROM p"))
def split_halves(spark, sf_dir):
    one, two = tables.split_halves(particles(spark, sf_dir).select("_row", "subset"))
    return one.select("_row", F.lit(1).alias("part")).union(two.select("_row", F.lit(2).alias("part")))


@query(
    "f5_contiguous_blocks",
    P("SELECT _row, CAST(CASE WHEN _row // (SELECT count(*) // 7 FROM p) < 7 THEN _row // (SELECT count(*) // 7 FROM p) ELSE 0 END AS INTEGER) AS block FROM p"),
)
def contiguous_blocks(spark, sf_dir):
    return tables.contiguous_blocks(particles(spark, sf_dir).select("_row"), 7)


@query("f6_sample_rows", P("SELECT _row, score FROM p QUALIFY row_number() OVER (ORDER BY substr(md5(CAST(_row AS VARCHAR) || ':5'), 1, 13), _row) <= 1000"))
def sample_rows(spark, sf_dir):
    return tables.sample_rows(particles(spark, sf_dir).select("_row", "score"), 1000, seed=5)


@query("f7_random_halves", P("SELECT _row, CAST(CASE WHEN substr(md5(CAST(_row AS VARCHAR) || ':9'), 1, 1) < '8' THEN 1 ELSE 2 END AS INTEGER) AS subset FROM p"))
def random_halves(spark, sf_dir):
    return tables.random_halves(particles(spark, sf_dir).select("_row"), seed=9)


@query(
    "f8_finite_rows",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'bad' WHEN 2 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS v FROM orders)
    SELECT o_orderkey, CAST(v AS DOUBLE) AS v FROM t WHERE o_orderkey % 5 > 2""",
)
def finite_rows(spark, sf_dir):
    five = F.col("o_orderkey") % 5
    text = F.when(five == 0, "NaN").when(five == 1, "bad").when(five > 2, F.col("o_totalprice").cast("string"))
    return tables.finite_rows(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("v")), ["v"])


@query(
    "f9_outlier_fence",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.7) AS b FROM lineitem)
    SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem, q WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY ALL""",
)
def outlier_fence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    kept = tables.outlier_fence(li, "l_extendedprice")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )


@query(
    "f10_mask_filter",
    with_(VOXELS) + """, m AS (SELECT i, avg(v) AS w FROM vox WHERE volume = 0 GROUP BY i)
    SELECT map, count(*) AS inside, round(min(v), 6) AS low, round(max(v), 6) AS high FROM vox JOIN m USING (i) WHERE w > 0.01 GROUP BY map""",
)
def mask_filter(spark, sf_dir):
    v = voxels(spark, sf_dir)
    mask = v.filter("volume = 0").groupBy("i").agg(F.avg("v").alias("w")).filter("w > 0.01").select("i")
    return v.join(mask, "i", "left_semi").groupBy("map").agg(
        F.count(F.lit(1)).alias("inside"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high")
    )


def _spoiled(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("px"))
    return emb.withColumn("px", F.when(F.col("id") % 7 == 0, F.transform("px", lambda v: F.when(v > 0.2, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("px")))


SPOILED = """bad AS (SELECT vec_id AS id, [CASE WHEN vec_id % 7 = 0 AND v > 0.2 THEN 'nan'::DOUBLE ELSE CAST(v AS DOUBLE) END FOR v IN embedding] AS px FROM embeddings)"""


@query(
    "f11_finite_images",
    with_(SPOILED) + """SELECT id, CASE WHEN len(list_filter(px, lambda v: isnan(v))) > 0 THEN 'non-finite pixel' ELSE 'ok' END AS state FROM bad""",
)
def finite_images(spark, sf_dir):
    good, rejected = tables.finite_images(_spoiled(spark, sf_dir))
    return good.select("id", F.lit("ok").alias("state")).unionByName(rejected.select("id", F.col("reason").alias("state")))


@query(
    "f11_zero_bad_pixels",
    with_(SPOILED) + "SELECT id, round(list_sum([CASE WHEN isnan(v) THEN 0 ELSE v END FOR v IN px]), 6) AS total FROM bad",
)
def zero_bad_pixels(spark, sf_dir):
    fixed = tables.finite_pixels(_spoiled(spark, sf_dir))
    return fixed.select("id", F.round(F.aggregate("px", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("o1_sort_by_number", P("SELECT _row, image_no, row_number() OVER (ORDER BY image_no, _row) - 1 AS place FROM p"))
def sort_by_number(spark, sf_dir):
    return ordered.ranked(particles(spark, sf_dir).select("_row", "image_no"), [], "image_no", out="place")


@query("o2_stable_sort", P("SELECT _row, tilt FROM p ORDER BY tilt DESC, _row"))
def stable_sort(spark, sf_dir):
    return tables.sort_rows(particles(spark, sf_dir).select("_row", "tilt"), "tilt", descending=True)


@query("o3_concat_position", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def concat_position(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.concat_by_position(first, table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("o3_concat_name", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def concat_name(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return tables.concat_by_name(a, b)


RESULTS = """SELECT c_custkey % 100 AS n, c_acctbal AS metric FROM customer UNION ALL SELECT s_suppkey % 100 + 50, s_acctbal FROM supplier"""


def _results(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("n"), F.col("c_acctbal").alias("metric"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100 + 50).alias("n"), F.col("s_acctbal").alias("metric"))
    return a, b


@query("o4_concat_sorted", RESULTS + " ORDER BY n, metric")
def concat_sorted(spark, sf_dir):
    a, b = _results(spark, sf_dir)
    return tables.concat_by_name(a, b).orderBy("n", "metric")


@query("o5_set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_difference(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("o6_upsert", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey IS NOT NULL")
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tables.upsert(old, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")


@query(
    "o8_append_with_optics",
    """SELECT 'particle' AS kind, count(*) AS n, count(DISTINCT c_nationkey) AS names FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'optics', count(*), count(DISTINCT k) FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""",
)
def append_with_optics(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("og"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("og"))
    parts, optics = tables.append_with_optics(a, a.distinct(), b, b.distinct(), "og")
    both = [
        df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("og").alias("names")).select(F.lit(kind).alias("kind"), "n", "names")
        for kind, df in (("particle", parts), ("optics", optics))
    ]
    return both[0].union(both[1])
