"""Particle, image, map and log tables derived from the given tables.

Each table exists twice: as a DataFrame and as SQL text for a ``WITH`` clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One particle per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_row"),
        ((F.col("o_orderkey") * 137) % 360 - 180).cast("double").alias("rot"),
        ((F.col("o_custkey") * 53) % 180).cast("double").alias("tilt"),
        ((F.col("o_orderkey") * 31) % 360).cast("double").alias("psi"),
        F.col("o_totalprice").alias("score"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("subset"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("class"),
        F.concat(F.lit("mics/"), F.col("o_orderstatus"), F.lit("/m"), (F.col("o_custkey") % 50).cast("string"), F.lit(".mrc")).alias("mic"),
        (F.col("o_custkey") % 40 + 1).cast("int").alias("image_no"),
        F.concat(F.lit("st/"), F.substring("o_orderpriority", 1, 1), F.lit(".mrcs")).alias("stack"),
        (F.col("o_orderkey") % 97).cast("double").alias("x"),
        (F.col("o_custkey") % 89).cast("double").alias("y"),
        F.col("o_custkey").alias("cust"),
    )


PARTICLES = """p AS (
  SELECT o_orderkey AS _row,
         CAST((o_orderkey * 137) % 360 - 180 AS DOUBLE) AS rot,
         CAST((o_custkey * 53) % 180 AS DOUBLE) AS tilt,
         CAST((o_orderkey * 31) % 360 AS DOUBLE) AS psi,
         o_totalprice AS score,
         CAST(o_orderkey % 2 + 1 AS INTEGER) AS subset,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS class,
         'mics/' || o_orderstatus || '/m' || CAST(o_custkey % 50 AS VARCHAR) || '.mrc' AS mic,
         CAST(o_custkey % 40 + 1 AS INTEGER) AS image_no,
         'st/' || substr(o_orderpriority, 1, 1) || '.mrcs' AS stack,
         CAST(o_orderkey % 97 AS DOUBLE) AS x,
         CAST(o_custkey % 89 AS DOUBLE) AS y,
         o_custkey AS cust
  FROM orders)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 maps, one per vector; ``volume`` groups the maps of one label."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("map"), F.col("label").alias("volume"), F.posexplode("embedding").alias("i", "v"))
        .select(
            "map",
            "volume",
            "i",
            F.floor(F.col("i") / 16).cast("int").alias("z"),
            F.floor(F.col("i") / 4 % 4).cast("int").alias("y"),
            (F.col("i") % 4).cast("int").alias("x"),
            F.col("v").cast("double").alias("v"),
        )
    )


VOXELS = """vox AS (
  SELECT map, volume, i, CAST(i // 16 AS INTEGER) AS z, CAST((i // 4) % 4 AS INTEGER) AS y,
         CAST(i % 4 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id AS map, label AS volume, unnest(embedding) AS v,
               CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM embeddings))"""


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 Fourier grids, one per vector; consecutive vectors are the two halves of a pair."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("map"),
            F.floor(F.col("vec_id") / 2).cast("bigint").alias("pair"),
            (F.col("vec_id") % 2 + 1).cast("int").alias("half"),
            "embedding",
            F.posexplode("embedding").alias("i", "v"),
        )
        .select(
            "map",
            "pair",
            "half",
            F.lit(0).alias("kz"),
            (F.floor(F.col("i") / 8) - 4).cast("int").alias("ky"),
            (F.col("i") % 8 - 4).cast("int").alias("kx"),
            F.col("v").cast("double").alias("re"),
            F.element_at("embedding", (F.col("i") * 7 + 3) % 64 + 1).cast("double").alias("im"),
        )
    )


COEFFICIENTS = """co AS (
  SELECT map, map // 2 AS pair, CAST(map % 2 + 1 AS INTEGER) AS half, CAST(0 AS INTEGER) AS kz,
         CAST(i // 8 - 4 AS INTEGER) AS ky, CAST(i % 8 - 4 AS INTEGER) AS kx,
         CAST(e[i + 1] AS DOUBLE) AS re, CAST(e[(i * 7 + 3) % 64 + 1] AS DOUBLE) AS im
  FROM (SELECT vec_id AS map, embedding AS e, CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM embeddings))"""


def volume_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors as 4 x 4 x 4 Fourier grids."""
    i = (F.col("ky") + 4) * 8 + F.col("kx") + 4
    return coefficients(spark, sf_dir).withColumns(
        {
            "kz": (F.floor(i / 16) - 2).cast("int"),
            "ky": (F.floor(i / 4) % 4 - 2).cast("int"),
            "kx": (i % 4 - 2).cast("int"),
        }
    )


VOLUME_COEFFICIENTS = COEFFICIENTS + """, cv AS (
  SELECT map, pair, half, CAST(i // 16 - 2 AS INTEGER) AS kz, CAST((i // 4) % 4 - 2 AS INTEGER) AS ky, CAST(i % 4 - 2 AS INTEGER) AS kx, re, im
  FROM (SELECT *, (ky + 4) * 8 + kx + 4 AS i FROM co))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: one session per user, alternating over steps."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("session"),
        F.when(F.col("event_type") == "view", "step_start")
        .when(F.col("event_type") == "click", "step_end")
        .when(F.col("event_type") == "signup", "session_start")
        .when(F.col("event_type") == "error", "session_end")
        .otherwise("note")
        .alias("event"),
        "ts",
        F.format_string("%02d_step", F.get_json_object("props", "$.k").cast("int") % 10).alias("step"),
        (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("iteration"),
        F.when(F.col("value") > 20, "finished").otherwise("aborted").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("rc"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("host"), (F.col("event_id") % 7).cast("string"))).alias("hostname"),
    )


EVENTS = """ev AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session,
         CASE event_type WHEN 'view' THEN 'step_start' WHEN 'click' THEN 'step_end'
              WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'session_end' ELSE 'note' END AS event,
         ts, printf('%02d_step', CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS step,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS VARCHAR) AS iteration,
         CASE WHEN value > 20 THEN 'finished' ELSE 'aborted' END AS status,
         CAST(event_id % 4 AS INTEGER) AS rc,
         CASE WHEN event_id % 3 = 0 THEN 'host' || CAST(event_id % 7 AS VARCHAR) END AS hostname
  FROM events)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection runs: one session per customer group, one iteration per order month."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            (F.col("o_custkey") % 7).cast("bigint").alias("session"),
            (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("bigint").alias("iteration"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice") / 1000, 1).alias("metric"))
    )


HISTORY = """hist AS (
  SELECT o_custkey % 7 AS session, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS iteration,
         count(*) AS n, round(min(o_totalprice) / 1000, 1) AS metric
  FROM orders GROUP BY 1, 2)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


VIEW_COUNT = 200

# The golden spiral and each particle's nearest view.
VIEWS = f"""spiral(ii, k) AS (
  SELECT 0, CAST(-1.0 AS DOUBLE)
  UNION ALL
  SELECT ii + 1, k + CAST(2.0 AS DOUBLE) / CAST({VIEW_COUNT - 1} AS DOUBLE) FROM spiral WHERE ii < {VIEW_COUNT - 1}),
view_angles AS (
  SELECT ii AS view, fmod(2 * pi() + fmod(ii * (3 - sqrt(5.0)) * pi(), 2 * pi()), 2 * pi()) * 180.0 / pi() AS vrot,
         acos(k) * 180.0 / pi() AS vtilt
  FROM spiral WHERE k <= 1.0),
view_points AS (
  SELECT view, sin(vtilt * 0.01745329251) * cos(vrot * 0.01745329251) AS vx,
         sin(vtilt * 0.01745329251) * sin(vrot * 0.01745329251) AS vy, sin(vtilt * 0.01745329251) AS vz
  FROM view_angles),
angles AS (SELECT DISTINCT rot, tilt FROM p),
nearest AS (
  SELECT rot, tilt, arg_min(view, struct_pack(d := d, v := view)) AS view FROM (
    SELECT rot, tilt, view,
           (sin(tilt * 0.01745329251) * cos(rot * 0.01745329251) - vx) ** 2
         + (sin(tilt * 0.01745329251) * sin(rot * 0.01745329251) - vy) ** 2
         + (sin(tilt * 0.01745329251) - vz) ** 2 AS d
    FROM angles CROSS JOIN view_points) GROUP BY rot, tilt),
placed AS (SELECT p.*, CAST(view AS INTEGER) AS view FROM p JOIN nearest USING (rot, tilt))"""
