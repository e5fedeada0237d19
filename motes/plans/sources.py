"""Ready-made queries on files that Spark first writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.functions import keys
from motes.operators import arrays
from motes.plans.registry import query
from motes.plans.standins import EVENTS, PARTICLES, events, particles, table, with_
from motes.session import scratch_path
from motes.sources import acquisition, blocks, exports, lines, logs, stacks


def P(body: str) -> str:
    return with_(PARTICLES) + body


def _star(spark, sf_dir):
    """Particles as a loop block."""
    path = scratch_path(spark, "loop")
    p = particles(spark, sf_dir).select("_row", keys.image_key(F.col("image_no"), F.col("stack")).alias("_rlnImageName"), F.col("rot").alias("_rlnAngleRot"),
                                        (F.col("score") / 7).alias("_rlnScore"), F.col("class").alias("_rlnClassNumber"), F.when(F.col("_row") % 5 > 0, F.col("mic")).alias("_rlnMicrographName"))
    blocks.write_loop(p, path)
    return path


STAR_TYPES = {"_rlnAngleRot": "double", "_rlnScore": "double", "_rlnClassNumber": "int"}


@query(
    "s1_read_loop",
    P("""SELECT lpad(CAST(image_no AS VARCHAR), 6, '0') || '@' || stack AS "_rlnImageName", rot AS "_rlnAngleRot", class AS "_rlnClassNumber", CASE WHEN _row % 5 > 0 THEN mic ELSE '?' END AS "_rlnMicrographName" FROM p"""),
)
def read_loop(spark, sf_dir):
    df = blocks.read_loop(spark, _star(spark, sf_dir), types=STAR_TYPES)
    return df.select("_rlnImageName", "_rlnAngleRot", "_rlnClassNumber", "_rlnMicrographName")


@query("s1_read_columns", P("""SELECT count(*) AS n, CAST(sum(class) AS BIGINT) AS classes, CAST(sum(rot) AS BIGINT) AS rots FROM p"""))
def read_columns(spark, sf_dir):
    df = blocks.read_loop(spark, _star(spark, sf_dir), columns=["_rlnClassNumber", "_rlnAngleRot"], types=STAR_TYPES)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("_rlnClassNumber").alias("classes"), F.sum("_rlnAngleRot").cast("bigint").alias("rots"))


@query("s4_write_loop", P("""SELECT printf('%.6f', score / 7)::DOUBLE AS score, class FROM p"""))
def write_loop(spark, sf_dir):
    df = blocks.read_loop(spark, _star(spark, sf_dir), types=STAR_TYPES)
    return df.select(F.col("_rlnScore").alias("score"), F.col("_rlnClassNumber").alias("class"))


@query(
    "s4_rows_in_order",
    P("""SELECT row_number() OVER (ORDER BY class > 2, _row) - 1 AS place, lpad(CAST(image_no AS VARCHAR), 6, '0') || '@' || stack AS image, class FROM p"""),
)
def rows_in_order(spark, sf_dir):
    """Written in two folders and read as one table, numbered through both."""
    path = scratch_path(spark, "parts")
    p = particles(spark, sf_dir).select("_row", keys.image_key(F.col("image_no"), F.col("stack")).alias("_rlnImageName"), F.col("class").alias("_rlnClassNumber"))
    blocks.write_loop(p.filter("_rlnClassNumber <= 2"), f"{path}/a")
    blocks.write_loop(p.filter("_rlnClassNumber > 2"), f"{path}/b")
    df = blocks.read_loop(spark, f"{path}/*", types=STAR_TYPES)
    return df.select(F.col("_row").alias("place"), F.col("_rlnImageName").alias("image"), F.col("_rlnClassNumber").alias("class"))


def _project(spark, sf_dir):
    """One file per nation: pairs, an optics loop and a particles loop of its customers."""
    path = scratch_path(spark, "project")
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    tomo = F.col("n_nationkey")
    head = n.select(tomo.alias("tomo"), F.lit(-1).cast("bigint").alias("o"), F.concat(F.lit("# written for a check\ndata_general\n\n_rlnTomoName   "), "n_name", F.lit("\n_rlnRegion "), F.col("n_regionkey").cast("string"),
                    F.lit("\n\ndata_optics\n\nloop_\n_rlnOpticsGroup #1\n_rlnOpticsGroupName #2\n"), F.col("n_nationkey").cast("string"), F.lit(" "), "n_name", F.lit("\n\ndata_particles\n\nloop_\n_rlnTomoParticleName #1\n_rlnOpticsGroup #2\n_rlnBalance #3")).alias("value"))
    body = c.select(F.col("c_nationkey").alias("tomo"), F.col("c_custkey").alias("o"), F.format_string("P%06d  %d   %s", F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal").cast("string")).alias("value"))
    head.union(body).repartition("tomo").sortWithinPartitions("tomo", "o").select("tomo", "value").write.partitionBy("tomo").text(path)
    return path


def _tomo(column="file"):
    return F.regexp_extract(column, r"tomo=(\d+)", 1).cast("int")


@query("s2_read_pairs", "SELECT n_nationkey AS tomo, 'general' AS block, '_rlnTomoName' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'general', '_rlnRegion', CAST(n_regionkey AS VARCHAR) FROM nation")
def read_pairs(spark, sf_dir):
    return blocks.read_pairs(spark, _project(spark, sf_dir)).select(_tomo().alias("tomo"), "block", "key", "value")


@query(
    "s3_block_catalog",
    """WITH n AS (SELECT n_nationkey AS tomo, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT tomo, CAST(b AS INTEGER) AS block_no, ['general', 'optics', 'particles'][b] AS block, CASE WHEN b = 1 THEN 'pairs' ELSE 'loop' END AS kind, CAST([0, 2, 3][b] AS INTEGER) AS n_cols,
      CASE b WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE k END AS n_rows, '3.1' AS version FROM n, range(1, 4) r(b)""",
)
def block_catalog(spark, sf_dir):
    return blocks.block_catalog(spark, _project(spark, sf_dir)).select(_tomo().alias("tomo"), "block_no", "block", "kind", "n_cols", "n_rows", "version")


@query(
    "o7_rebuild_master",
    """SELECT 'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS particle, c_nationkey AS optics_group, n_name AS optics_name, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def rebuild_master(spark, sf_dir):
    files = blocks.BlockFiles(spark, _project(spark, sf_dir))  # one index for both blocks
    kinds = {"_rlnOpticsGroup": "int", "_rlnBalance": "double"}
    parts = files.loop("particles", types=kinds)
    optics = files.loop("optics", types=kinds).groupBy("_rlnOpticsGroup").agg(F.min_by("_rlnOpticsGroupName", F.struct("_file", "_row")).alias("optics_name"))
    return parts.join(optics, "_rlnOpticsGroup").select(F.col("_rlnTomoParticleName").alias("particle"), F.col("_rlnOpticsGroup").alias("optics_group"), "optics_name", F.col("_rlnBalance").alias("balance"))


@query("s5_csv_export", P("SELECT _row, rot AS phi, tilt AS theta, psi FROM p"))
def csv_export(spark, sf_dir):
    path = scratch_path(spark, "csv")
    exports.write_csv(particles(spark, sf_dir).select("_row", "rot", "tilt", "psi"), path, {"rot": "phi", "tilt": "theta"})
    return spark.read.schema("_row bigint, phi double, theta double, psi double").option("header", "true").csv(path)


@query("s6_column_export", P("SELECT stack AS value, count(*) AS n FROM p GROUP BY 1"))
def column_export(spark, sf_dir):
    path = scratch_path(spark, "column")
    exports.write_column(particles(spark, sf_dir).select("_row", "stack"), path, "stack")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("s6_direction_export", P("SELECT printf('%.6f %.6f', rot, tilt) AS value FROM p"))
def direction_export(spark, sf_dir):
    path = scratch_path(spark, "directions")
    exports.write_column(exports.direction_lines(particles(spark, sf_dir)).select("_row", "value"), path, "value")
    return spark.read.text(path)


@query("s7_affine_rows", P("SELECT _row, round(cos(radians(psi)), 9) AS a11, round(-sin(radians(psi)), 9) AS a12, round(sin(radians(psi)), 9) AS a21, round(cos(radians(psi)), 9) AS a22, x AS dx, y AS dy, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM p"))
def affine_rows(spark, sf_dir):
    p = particles(spark, sf_dir).select("_row", "psi", "x", "y")
    out = exports.zero_origins(exports.affine_rows(p))
    return out.select("_row", *[F.round(c, 9).alias(c) for c in ("a11", "a12", "a21", "a22")], "dx", "dy", "x", "y")


def _picks(spark, sf_dir, header, layout, sep):
    path = scratch_path(spark, "picks")
    k = F.col("s_suppkey") % 4
    head = table(spark, sf_dir, "supplier").select(k.alias("tomo"), F.lit(-1).cast("bigint").alias("o"), F.lit(header).alias("value")).distinct()
    at = {"x": F.col("s_suppkey") * 0.5, "y": F.col("s_nationkey") + 0.25, "z": F.col("s_acctbal")}
    body = table(spark, sf_dir, "supplier").select(k.alias("tomo"), F.col("s_suppkey").alias("o"), F.concat_ws(sep, *[at[a].cast("string") if a in at else F.lit("9") for a in layout]).alias("value"))
    whole = head.union(body) if header else body
    whole.repartition("tomo").sortWithinPartitions("tomo", "o").select("tomo", "value").write.partitionBy("tomo").text(path)
    return path


PICKED = "SELECT CAST(s_suppkey % 4 AS INTEGER) AS tomo, s_suppkey // 4 AS _row, s_suppkey * 0.5 AS x, s_nationkey + 0.25 AS y, s_acctbal AS z FROM supplier".replace("s_suppkey * 0.5", "CAST(s_suppkey * 0.5 AS DOUBLE)").replace("s_nationkey + 0.25", "CAST(s_nationkey + 0.25 AS DOUBLE)")


@query("s8_picks_named", PICKED)
def picks_named(spark, sf_dir):
    path = _picks(spark, sf_dir, "Id,Z,X,Y", ["id", "z", "x", "y"], ",")
    return acquisition.read_picks(spark, path).select(_tomo("_file").alias("tomo"), "_row", "x", "y", "z")


@query("s8_picks_axes", PICKED)
def picks_axes(spark, sf_dir):
    path = _picks(spark, sf_dir, "index,axis-0,axis-1,axis-2", ["id", "z", "y", "x"], ",")
    return acquisition.read_picks(spark, path).select(_tomo("_file").alias("tomo"), "_row", "x", "y", "z")


@query("s8_picks_points", PICKED)
def picks_points(spark, sf_dir):
    path = _picks(spark, sf_dir, "", ["y", "z", "x"], "  ")
    return acquisition.read_picks(spark, path, "points", "yzx").select(_tomo("_file").alias("tomo"), "_row", "x", "y", "z")


def _notes(spark, sf_dir, value, name, per_tomo=None):
    """One text file per brand with a line (or lines) per part."""
    path = scratch_path(spark, name)
    p = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).alias("tomo"), F.col("p_partkey").alias("o"), value.alias("value"))
    if per_tomo is not None:
        p = p.select("tomo").distinct().select("tomo", F.lit(-1).cast("bigint").alias("o"), per_tomo.alias("value")).union(p)
    p.repartition("tomo").sortWithinPartitions("tomo", "o").select("tomo", "value").write.partitionBy("tomo").text(path)
    return path


BRAND = "CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)"


@query(
    "s9_read_affine",
    f"""SELECT {BRAND} AS tomo, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS tilt_index, 1.0::DOUBLE AS a11, 0.5::DOUBLE AS a12, 0.0::DOUBLE AS a21, 1.25::DOUBLE AS a22, CAST(p_size AS DOUBLE) AS dx, p_retailprice AS dy FROM part WHERE p_partkey % 10 > 0""",
)
def read_affine(spark, sf_dir):
    line = F.when(F.col("p_partkey") % 10 == 0, F.lit("# a note")).otherwise(F.concat(F.lit("   1.0  0.5 0.0   1.25  "), F.col("p_size").cast("string"), F.lit("  "), F.col("p_retailprice").cast("string")))
    return acquisition.read_affine(spark, _notes(spark, sf_dir, line, "affine")).withColumn("file", _tomo()).withColumnRenamed("file", "tomo")


@query("s9_read_tilt_angles", f"SELECT {BRAND} AS tomo, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS tilt_index, CAST(p_size * 1.5 - 30 AS DOUBLE) AS tilt_angle FROM part")
def read_tilt_angles(spark, sf_dir):
    path = _notes(spark, sf_dir, (F.col("p_size") * 1.5 - 30).cast("string"), "angles")
    return acquisition.read_tilt_angles(spark, path).withColumn("file", _tomo()).withColumnRenamed("file", "tomo")


@query(
    "s10_read_acquisition",
    f"""WITH q AS (SELECT {BRAND} AS tomo, CAST(p_partkey AS INTEGER) AS z, p_size, p_type FROM part)
    SELECT tomo, z, 'TiltAngle' AS key, CAST(p_size AS VARCHAR) AS value FROM q UNION ALL SELECT tomo, z, 'Kind', p_type || ' = x' FROM q UNION ALL SELECT DISTINCT tomo, NULL, 'PixelSpacing', '1.35' FROM q""",
)
def read_acquisition(spark, sf_dir):
    line = F.format_string("[ZValue = %d]\nTiltAngle = 99\nKind = %s = x\n\nTiltAngle = %d", "p_partkey", "p_type", "p_size")
    path = _notes(spark, sf_dir, line, "acquisition", F.lit("PixelSpacing = 1.35"))
    return acquisition.read_acquisition(spark, path).select(_tomo().alias("tomo"), "z", "key", "value")


@query("s10_read_commands", f"SELECT {BRAND} AS tomo, upper(p_type) AS key, arg_max(p_name, p_partkey) AS value FROM part GROUP BY 1, 2")
def read_commands(spark, sf_dir):
    path = _notes(spark, sf_dir, F.concat(F.lit("$program -flag\n"), F.upper("p_type"), F.lit("   "), F.col("p_name")), "commands")
    return acquisition.read_commands(spark, path).select(_tomo().alias("tomo"), "key", "value")


@query(
    "s11_read_defocus",
    f"""SELECT {BRAND} AS tomo, p_size AS view_start, p_size + 2 AS view_end, p_retailprice AS defocus_u, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice + 10 ELSE p_retailprice END AS defocus_v,
      CASE WHEN p_partkey % 3 > 0 THEN 15.5::DOUBLE ELSE 0::DOUBLE END AS astig_angle, CASE WHEN p_partkey % 3 = 2 THEN 90::DOUBLE ELSE 0::DOUBLE END AS phase_shift FROM part""",
)
def read_defocus(spark, sf_dir):
    third = F.col("p_partkey") % 3
    price = F.col("p_retailprice").cast("string")
    line = F.concat_ws(" ", F.col("p_size").cast("string"), (F.col("p_size") + 2).cast("string"), F.lit("-10 -8"), price, F.when(third > 0, F.concat((F.col("p_retailprice") + 10).cast("string"), F.lit(" 15.5"))), F.when(third == 2, F.lit("90")))
    path = _notes(spark, sf_dir, line, "defocus", F.lit("1 0 0. 0. 0 3"))
    return acquisition.read_defocus(spark, path).select(_tomo().alias("tomo"), "view_start", "view_end", "defocus_u", "defocus_v", "astig_angle", "phase_shift")


def _saved_arrays(spark, sf_dir, fill):
    """Structured arrays of at most 1,000 customers per file, written by the tasks. ``fill`` makes an array of their rows."""
    import os

    folder = scratch_path(spark, "arrays")

    def save(key, pdf):
        import numpy as np
        from pyarrow import fs

        data = fill(pdf.sort_values("c_custkey").reset_index(drop=True))
        uri = folder if "://" in folder else folder.replace("file:", "", 1)
        system, place = fs.FileSystem.from_uri(uri)
        system.create_dir(place)
        import io

        buf = io.BytesIO()
        np.save(buf, data)
        name = os.path.join(place, f"part{key[0]}.npy")
        with system.open_output_stream(name) as f:
            f.write(buf.getvalue())
        return pdf[["c_custkey"]].head(1)

    table(spark, sf_dir, "customer").withColumn("part", F.floor(F.col("c_custkey") / 1000)).groupBy("part").applyInPandas(save, "c_custkey bigint").count()
    return folder


def _arrays(spark, sf_dir):
    def fill(pdf):
        import numpy as np

        data = np.zeros(len(pdf), [("blob/path", "S40"), ("blob/idx", "<i4"), ("alignments3D/shift", "<f4", (2,)), ("ctf/df1_A", "<f8")])
        data["blob/path"] = pdf["c_name"].str.encode("utf-8")
        data["blob/idx"] = pdf["c_custkey"]
        data["alignments3D/shift"] = np.stack([pdf["c_nationkey"], pdf["c_nationkey"] * 0.5], 1)
        data["ctf/df1_A"] = pdf["c_acctbal"]
        return data

    return _saved_arrays(spark, sf_dir, fill)


ARRAY_FIELDS = {
    "blob/path": "string", "blob/idx": "int", "blob/shape": "array<int>", "blob/psize_A": "double", "ctf/accel_kv": "double", "ctf/cs_mm": "double",
    "ctf/amp_contrast": "double", "ctf/df1_A": "double", "ctf/df2_A": "double", "ctf/df_angle_rad": "double", "ctf/phase_shift_rad": "double", "ctf/bfactor": "double",
}
ALIGNED_FIELDS = {"alignments3D/pose": "array<double>", "alignments3D/shift": "array<double>", "alignments3D/class": "int"}


def _external(spark, sf_dir, fields):
    """Customers as particles of another program: a folder per nation, turned about the second axis."""

    def fill(pdf):
        import numpy as np

        n = len(pdf)
        kind = [("blob/path", "S60"), ("blob/idx", "<i4"), ("blob/shape", "<i4", (2,)), *[(f, "<f8") for f, t in ARRAY_FIELDS.items() if t == "double"]]
        data = np.zeros(n, [*kind, ("alignments3D/pose", "<f8", (3,)), ("alignments3D/shift", "<f8", (2,)), ("alignments3D/class", "<i4")])
        data["blob/path"] = (">J" + pdf["c_nationkey"].astype(str) + "/extract/s.mrc").str.encode("utf-8")
        data["blob/idx"], data["blob/shape"], data["blob/psize_A"] = pdf["c_custkey"], (256, 128), 1.25
        data["ctf/accel_kv"], data["ctf/cs_mm"], data["ctf/amp_contrast"] = 300 - pdf["c_nationkey"], 2.7, 0.1
        data["ctf/df1_A"], data["ctf/df2_A"], data["ctf/df_angle_rad"] = pdf["c_acctbal"], pdf["c_acctbal"] + 100, pdf["c_nationkey"] / 7
        data["alignments3D/pose"][:, 1] = np.radians(pdf["c_custkey"] % 170 + 1)
        data["alignments3D/shift"] = np.stack([pdf["c_nationkey"], pdf["c_nationkey"] * 0.5], 1)
        data["alignments3D/class"] = pdf["c_custkey"] % 4
        return data

    rows = stacks.read_structured(spark, _saved_arrays(spark, sf_dir, fill), fields)
    number = F.regexp_extract("_file", r"part(\d+)", 1).cast("bigint") * 1000 + F.col("_row")
    return rows.withColumn("_row", number)


def _rounded_columns(df, names):
    return df.select("_rlnImageName", "_rlnOpticsGroup", "_rlnClassNumber", "_rlnRandomSubset", *[F.round(n, 6).alias(n) for n in names])


ORIGINS = ["_rlnAngleRot", "_rlnAngleTilt", "_rlnAnglePsi", "_rlnOriginXAngst", "_rlnOriginYAngst"]
FIRST_SEEN = "WITH g AS (SELECT c_nationkey AS k, row_number() OVER (ORDER BY min(c_custkey)) AS og FROM customer GROUP BY 1)"
IMAGE = """lpad(CAST(c_custkey + 1 AS VARCHAR), 6, '0') || '@J' || c_nationkey || '/extract/s.mrc' AS "_rlnImageName" """


@query(
    "x5_array_particles",
    FIRST_SEEN + f"""SELECT {IMAGE}, og AS "_rlnOpticsGroup", CAST(c_custkey % 4 + 1 AS INTEGER) AS "_rlnClassNumber", CAST(1 AS INTEGER) AS "_rlnRandomSubset", 0.0::DOUBLE AS "_rlnAngleRot",
    CAST(c_custkey % 170 + 1 AS DOUBLE) AS "_rlnAngleTilt", 0.0::DOUBLE AS "_rlnAnglePsi", c_nationkey * 1.25::DOUBLE AS "_rlnOriginXAngst", c_nationkey * 0.625::DOUBLE AS "_rlnOriginYAngst",
    round(degrees(c_nationkey / 7.0), 6) AS "_rlnDefocusAngle" FROM customer JOIN g ON k = c_nationkey""",
)
def array_particles(spark, sf_dir):
    """The pixel size comes from the images, as the alignment has none."""
    _, particles_ = arrays.particles_from_array(_external(spark, sf_dir, ARRAY_FIELDS | ALIGNED_FIELDS))
    return _rounded_columns(particles_, [*ORIGINS, "_rlnDefocusAngle"])


@query(
    "x5_array_optics",
    FIRST_SEEN + """SELECT og AS "_rlnOpticsGroup", CAST(300 - k AS DOUBLE) AS "_rlnVoltage", 2.7::DOUBLE AS "_rlnSphericalAberration", 0.1::DOUBLE AS "_rlnAmplitudeContrast", 1.25::DOUBLE AS "_rlnImagePixelSize",
    CAST(128 AS INTEGER) AS "_rlnImageSize", CAST(2 AS INTEGER) AS "_rlnImageDimensionality" FROM g""",
)
def array_optics(spark, sf_dir):
    return arrays.particles_from_array(_external(spark, sf_dir, ARRAY_FIELDS | ALIGNED_FIELDS))[0]


@query(
    "x6_array_without_pose",
    FIRST_SEEN + f"""SELECT {IMAGE}, og AS "_rlnOpticsGroup", CAST(1 AS INTEGER) AS "_rlnClassNumber", CAST(1 AS INTEGER) AS "_rlnRandomSubset", 0.0::DOUBLE AS "_rlnAngleRot",
    0.0::DOUBLE AS "_rlnAngleTilt", 0.0::DOUBLE AS "_rlnAnglePsi", 0.0::DOUBLE AS "_rlnOriginXAngst", 0.0::DOUBLE AS "_rlnOriginYAngst" FROM customer JOIN g ON k = c_nationkey""",
)
def array_without_pose(spark, sf_dir):
    _, particles_ = arrays.particles_from_array(_external(spark, sf_dir, ARRAY_FIELDS), missing_to_zero=True)
    return _rounded_columns(particles_, ORIGINS)


@query("s12_structured_arrays", "SELECT c_name AS path, CAST(c_custkey AS INTEGER) AS idx, CAST(c_nationkey AS DOUBLE) AS shift_x, CAST(c_nationkey * 0.5 AS DOUBLE) AS shift_y, c_acctbal AS defocus, c_custkey % 1000 AS _row FROM customer")
def structured_arrays(spark, sf_dir):
    fields = {"blob/path": "string", "blob/idx": "int", "alignments3D/shift": "array<double>", "ctf/df1_A": "double"}
    df = stacks.read_structured(spark, _arrays(spark, sf_dir), fields)
    s = F.col("`alignments3D/shift`")
    return df.select(F.col("`blob/path`").alias("path"), F.col("`blob/idx`").alias("idx"), s[0].alias("shift_x"), s[1].alias("shift_y"), F.col("`ctf/df1_A`").alias("defocus"), "_row")


def _stacks(spark, sf_dir):
    """Image stacks of 100 vectors each, written by the tasks."""
    import os

    folder = scratch_path(spark, "stacks")

    def save(key, pdf):
        import numpy as np
        from pyarrow import fs

        pdf = pdf.sort_values("vec_id")
        whole, real = np.zeros(256, "<i4"), np.zeros(256, "<f4")
        whole[0:4] = [8, 8, len(pdf), 2]
        whole[7:10] = [8, 8, len(pdf)]
        whole[23] = 64
        head = whole.copy()
        head[10:13] = np.array([12.0, 12.0, 1.5 * len(pdf)], "<f4").view("<i4")
        uri = folder if "://" in folder else folder.replace("file:", "", 1)
        system, place = fs.FileSystem.from_uri(uri)
        system.create_dir(place)
        with system.open_output_stream(os.path.join(place, f"s{key[0]}.mrcs")) as f:
            f.write(head.tobytes() + b"\0" * 64 + np.stack(pdf["embedding"].to_numpy()).astype("<f4").tobytes())
        return pdf[["vec_id"]].head(1)

    table(spark, sf_dir, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 100)).groupBy("part").applyInPandas(save, "vec_id bigint").count()
    return folder


STACK_NO = r"s(\d+)\.mrcs$"


@query("s13_stack_headers", "SELECT vec_id // 100 AS stack, CAST(8 AS INTEGER) AS nx, CAST(8 AS INTEGER) AS ny, CAST(count(*) AS INTEGER) AS nz, CAST(2 AS INTEGER) AS mode, CAST(1088 AS BIGINT) AS data_offset, CAST(1.5 AS DOUBLE) AS pixel_x FROM embeddings GROUP BY 1")
def stack_headers(spark, sf_dir):
    h = stacks.stack_headers(spark, _stacks(spark, sf_dir))
    return h.select(F.regexp_extract("path", STACK_NO, 1).cast("bigint").alias("stack"), "nx", "ny", "nz", "mode", "data_offset", "pixel_x")


@query("s13_read_slices", "SELECT vec_id // 100 AS stack, CAST(vec_id % 100 AS INTEGER) AS slice, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 5) AS total, embedding[10] AS pixel FROM embeddings")
def read_slices(spark, sf_dir):
    s = stacks.read_slices(stacks.stack_headers(spark, _stacks(spark, sf_dir)))
    total = F.aggregate("px", F.lit(0.0), lambda a, x: a + x)
    return s.select(F.regexp_extract("stack", STACK_NO, 1).cast("bigint").alias("stack"), "slice", F.round(total, 5).alias("total"), F.col("px")[9].alias("pixel"))


def _log(spark, sf_dir):
    path = scratch_path(spark, "log")
    ev = events(spark, sf_dir).select("seq", F.to_json(F.struct("event", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "iteration", "step", "status", F.col("rc").cast("string").alias("rc"), "hostname", F.col("session").alias("tag"))).alias("j"))
    line = F.when(F.col("seq") % 50 == 7, F.substring("j", 1, 20)).when(F.col("seq") % 50 == 8, F.lit("not json")).otherwise(F.col("j"))
    ev.select(line.alias("value")).write.text(path)
    return path


@query("s14_read_events", with_(EVENTS) + "SELECT session AS tag, event, iteration, step, status, CAST(rc AS VARCHAR) AS rc, hostname FROM ev WHERE seq % 50 NOT IN (7, 8)")
def read_events(spark, sf_dir):
    return logs.read_events(spark, _log(spark, sf_dir)).select("tag", "event", "iteration", "step", "status", "rc", "hostname")


@query("s14_count_malformed", with_(EVENTS) + "SELECT count(*) FILTER (seq % 50 NOT IN (7, 8)) AS events, count(*) FILTER (seq % 50 IN (7, 8)) AS malformed FROM ev")
def count_malformed(spark, sf_dir):
    return logs.count_malformed(spark, _log(spark, sf_dir))


@query("s15_read_timings", with_(EVENTS) + "SELECT iteration, step, CAST(seq % 1000 AS INTEGER) AS elapsed_s, rc, CASE WHEN rc = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM ev WHERE event = 'step_end'")
def read_timings(spark, sf_dir):
    path = scratch_path(spark, "timings")
    ev = events(spark, sf_dir).filter("event = 'step_end'")
    exports.write_csv(ev.select("iteration", "step", F.date_format("ts", "HH:mm:ss").alias("t_start"), F.date_format("ts", "HH:mm:ss").alias("t_end"), (F.col("seq") % 1000).alias("elapsed_s"), "rc"), path)
    return logs.read_timings(spark, path).select("iteration", "step", "elapsed_s", "rc", "result")


@query("s16_list_files", "SELECT n_nationkey AS tomo, count(*) AS files FROM nation GROUP BY 1")
def list_files(spark, sf_dir):
    listed = lines.list_files(spark, _project(spark, sf_dir), {"tomo": r"tomo=(\d+)/part-[^/]*\.txt$"})
    return listed.filter("length > 0 and tomo is not null").groupBy(F.col("tomo").cast("int").alias("tomo")).agg(F.count(F.lit(1)).alias("files"))


@query("s17_reject_log", "SELECT CAST(vec_id AS VARCHAR) AS image, 'non-finite pixel' AS reason FROM embeddings WHERE vec_id % 7 = 0 AND list_max(embedding) > 0.2 UNION ALL SELECT CAST(vec_id AS VARCHAR), 'label 3' FROM embeddings WHERE label = 3")
def reject_log(spark, sf_dir):
    from motes.operators.tables import finite_images

    path = scratch_path(spark, "rejects")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image"), "label", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda v: F.when(v > 0.2, F.lit(float("nan")).cast("float")).otherwise(v))).otherwise(F.col("embedding")).alias("px"))
    exports.append_rejects(finite_images(e)[1].select("image", "reason"), path)
    exports.append_rejects(e.filter("label = 3").select("image", F.lit("label 3").alias("reason")), path)
    return spark.read.parquet(path)
