"""Ready-made consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.functions.fixed import OPTICS_COLUMNS
from motes.operators import quality as ops
from motes.operators import tomography as tomo
from motes.plans.registry import query
from motes.plans.sources import _project, _tomo
from motes.plans.standins import table
from motes.sources.blocks import block_catalog

HEADS = "h AS (SELECT n_nationkey AS tomo, CAST(50 + n_nationkey % 3 AS INTEGER) AS nx, CAST(60 AS INTEGER) AS ny, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS nz, CASE WHEN n_nationkey % 6 = 5 THEN 0.0 ELSE 1.35 END AS pixel_x FROM nation)"


def _headers(spark, sf_dir):
    n = F.col("n_nationkey")
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    return table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").select(
        n.alias("tomo"), (50 + n % 3).alias("nx"), F.lit(60).alias("ny"), (F.coalesce("k", F.lit(0)) + F.when(n % 4 == 0, 1).otherwise(0)).cast("int").alias("nz"), F.when(n % 6 == 5, F.lit(0.0)).otherwise(F.lit(1.35)).alias("pixel_x")
    )


CHECKS = f"""WITH {HEADS}, c AS (
  SELECT 'tilts:' || CAST(tomo AS VARCHAR) AS "check", CASE WHEN nz = k THEN 'pass' ELSE 'fail' END AS status, 'critical' AS severity, 'depth=' || CAST(nz AS VARCHAR) || ' rows=' || CAST(k AS VARCHAR) AS detail
    FROM (SELECT h.*, (SELECT count(*) FROM customer WHERE c_nationkey = tomo) AS k FROM h)
  UNION ALL SELECT 'pixel_size:' || CAST(tomo AS VARCHAR), CASE WHEN pixel_x > 0 THEN 'pass' ELSE 'fail' END, 'warning', printf('pixel_x=%.4f', pixel_x) FROM h
  UNION ALL SELECT 'coordinate_roundtrip:' || CAST(tomo AS VARCHAR), 'pass', 'critical', 'centre' FROM h)
"""


def _checks(spark, sf_dir):
    h = _headers(spark, sf_dir)
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tomo"))
    size = [F.col(c).cast("double") for c in ("nx", "ny", "nz")]
    centre = [c / 2 / 4.0 for c in size]
    error = tomo.roundtrip_error(centre, size, F.lit(1.35), F.lit(4.0))
    trip = ops.check_rows(h, F.concat(F.lit("coordinate_roundtrip:"), F.col("tomo").cast("string")), error < 0.5, "critical", F.lit("centre"))
    return ops.all_checks(ops.depth_check(h, rows, "tomo", "tilts"), ops.pixel_check(h, "tomo"), trip)


@query("q1_verdict", CHECKS + """SELECT count(*) AS checks, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'fail' AND severity = 'critical') AS critical, count(*) FILTER (status = 'fail' AND severity = 'critical') = 0 AS ok FROM c""")
def verdict(spark, sf_dir):
    return ops.verdict(_checks(spark, sf_dir))


@query("q3_checks", CHECKS + "SELECT * FROM c")
def checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(
    "q2_missing_columns",
    "SELECT n_nationkey AS tomo, 'optics' AS block, l AS label FROM nation, (SELECT unnest(['_rlnTomoTiltSeriesPixelSize', '_rlnVoltage', '_rlnSphericalAberration', '_rlnAmplitudeContrast']) AS l) UNION ALL SELECT n_nationkey, 'particles', '_rlnTomoName' FROM nation",
)
def missing_columns(spark, sf_dir):
    catalog = block_catalog(spark, _project(spark, sf_dir))
    out = ops.missing_columns(catalog, {"optics": OPTICS_COLUMNS, "particles": ["_rlnTomoName", "_rlnTomoParticleName", "_rlnOpticsGroup"]})
    return out.select(_tomo().alias("tomo"), "block", "label")


@query("q2_foreign_columns", "SELECT n_nationkey AS tomo, 'particles' AS block, '_rlnBalance' AS label FROM nation")
def foreign_columns(spark, sf_dir):
    catalog = block_catalog(spark, _project(spark, sf_dir))
    return ops.foreign_columns(catalog, "particles", "_rlnB").select(_tomo().alias("tomo"), "block", "label")


@query("q4_dangling_references", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 5 > 0)")
def dangling_references(spark, sf_dir):
    fact = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    dim = table(spark, sf_dir, "supplier").filter("s_nationkey % 5 > 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return ops.dangling_references(fact, dim, "c_nationkey")


@query("q5_same_geometry", f"WITH {HEADS} SELECT tomo, tomo % 3 = 0 AS same_size, pixel_x > 1 AS same_pixel FROM h")
def same_geometry(spark, sf_dir):
    h = _headers(spark, sf_dir)
    other = h.withColumn("nx", F.lit(50)).withColumn("pixel_x", F.lit(1.35))
    return ops.same_geometry(h, other, "tomo")
