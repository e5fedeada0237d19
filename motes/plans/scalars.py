"""Ready-made queries on single-row expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.functions import angles, cells, keys, logs
from motes.operators import tomography as tomo
from motes.plans.registry import query
from motes.plans.standins import PARTICLES, particles, table, with_


def P(body: str) -> str:
    return with_(PARTICLES) + body


@query("x1_image_key", P("SELECT _row, image_no, stack, lpad(CAST(image_no AS VARCHAR), 6, '0') || '@' || stack AS image FROM p"))
def image_key(spark, sf_dir):
    image = particles(spark, sf_dir).select("_row", keys.image_key(F.col("image_no"), F.col("stack")).alias("image"))
    return image.select("_row", keys.image_no(F.col("image")).alias("image_no"), keys.stack_name(F.col("image")).alias("stack"), "image")


RAW = r"""r AS (SELECT page_id, '>' || replace(replace(url, '/', chr(92)), '?', '/0' || CAST(page_id AS VARCHAR) || '_m_particles.') AS path FROM pages), s AS (SELECT page_id, ltrim(replace(path, chr(92), '/'), '>') AS path FROM r), q AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name FROM s)"""


@query(
    "x2_clean_path",
    with_(RAW)
    + r"""SELECT page_id, path AS plain, regexp_replace(name, '^\d+_', '') AS no_prefix, 'new/dir/' || regexp_replace(name, '_particles(\.[^.]*)?$', '\1') AS moved FROM q""",
)
def clean_path(spark, sf_dir):
    raw = F.concat(F.lit(">"), F.replace(F.translate("url", "/", "\\"), F.lit("?"), F.concat(F.lit("/0"), F.col("page_id").cast("string"), F.lit("_m_particles."))))
    df = table(spark, sf_dir, "pages").select("page_id", raw.alias("path"))
    c = F.col("path")
    return df.select(
        "page_id",
        keys.clean_path(c).alias("plain"),
        keys.clean_path(c, drop_directory=True, drop_digit_prefix=True).alias("no_prefix"),
        keys.clean_path(c, drop_particles_suffix=True, new_directory="new\\dir/").alias("moved"),
    )


@query(
    "x2_names",
    r"""WITH k AS (SELECT c_custkey, '000012@a/b.c/' || CAST(c_custkey * 1000003 AS VARCHAR) || '_' || c_name || '_x-1.mrcs' AS k FROM customer)
    SELECT c_custkey, translate(regexp_replace(regexp_replace(k, '^.*/', ''), '\.[^.]*$', ''), '._-', '') AS simple, regexp_replace(regexp_replace(k, '^.*/', ''), '^\d{8,}_', '') AS base,
      '000012@a/b.c/' || regexp_replace(regexp_replace(k, '^.*/', ''), '^[^_]*_', '') AS no_prefix, '000012@new.mrcs' AS replaced, 'a/b.c' AS folder, regexp_extract(k, '[^/]*/[^/]*$') AS last_two FROM k""",
)
def names(spark, sf_dir):
    k = F.concat(F.lit("000012@a/b.c/"), (F.col("c_custkey") * 1000003).cast("string"), F.lit("_"), "c_name", F.lit("_x-1.mrcs"))
    c = F.col("k")
    return table(spark, sf_dir, "customer").select("c_custkey", k.alias("k")).select(
        "c_custkey", keys.simple_name(c).alias("simple"), keys.stack_base(c).alias("base"), keys.drop_name_prefix(c).alias("no_prefix"), keys.replace_stack(c, "new.mrcs").alias("replaced"),
        keys.directory(keys.stack_name(c)).alias("folder"), keys.last_parts(c, 1).alias("last_two"),
    )


@query(
    "x3_angles",
    P("""SELECT _row, round(fmod(fmod(rot * 3.7, 360) + 360, 360), 6) AS wrapped, round((sin(tilt*k)*cos(rot*k) - sin(psi*k)*cos(y*k))**2 + (sin(tilt*k)*sin(rot*k) - sin(psi*k)*sin(y*k))**2 + (sin(tilt*k) - sin(psi*k))**2, 9) AS d_compat,
      round((sin(tilt*k)*cos(rot*k) - sin(psi*k)*cos(y*k))**2 + (sin(tilt*k)*sin(rot*k) - sin(psi*k)*sin(y*k))**2 + (cos(tilt*k) - cos(psi*k))**2, 9) AS d_true FROM p, (SELECT 0.01745329251 AS k)"""),
)
def view_angles(spark, sf_dir):
    c = [F.col(n) for n in ("rot", "tilt", "y", "psi")]
    return particles(spark, sf_dir).select(
        "_row", F.round(angles.wrapped(F.col("rot") * 3.7), 6).alias("wrapped"), F.round(angles.direction_distance2(*c), 9).alias("d_compat"), F.round(angles.direction_distance2(*c, compat=False), 9).alias("d_true")
    )


# A rotation vector along (1, 2, 2) / 3, so its length and the matrix have short forms.
VECTOR = """v AS (SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 100 = 0 THEN 0.0 ELSE (o_orderkey % 157 + 1) / 100.0 END AS th FROM orders),
m AS (SELECT _row, th, 1 - cos(th) AS c, sin(th) AS s, 1/3.0 AS x, 2/3.0 AS y, 2/3.0 AS z FROM v),
mat AS (SELECT _row, th, c*x*z + s*y AS m02, c*y*z - s*x AS m12, c*x*z - s*y AS m20, c*y*z + s*x AS m21, 1 - c*(x*x + y*y) AS m22 FROM m)"""
ANGLES = "round(degrees(atan2(m12, m02)), 6) AS rot, round(degrees(acos(greatest(-1, least(1, m22)))), 6) AS tilt, round(degrees(atan2(m21, 0 - m20)), 6) AS psi"


def _poses(spark, sf_dir):
    k = F.col("o_orderkey")
    th = F.when(k % 100 == 0, F.lit(0.0)).otherwise((k % 157 + 1) / 100.0)
    return table(spark, sf_dir, "orders").select(k.alias("_row"), th.alias("th"))


def _angled(df, pose, length):
    rot, tilt, psi = angles.pose_angles(pose, length)
    return df.select("_row", F.round(rot, 6).alias("rot"), F.round(tilt, 6).alias("tilt"), F.round(psi, 6).alias("psi"))


@query("x4_rotation_vector", with_(VECTOR) + f"SELECT _row, {ANGLES} FROM mat")
def rotation_vector(spark, sf_dir):
    df = _poses(spark, sf_dir).withColumn("pose", F.array(F.col("th") / 3, F.col("th") * 2 / 3, F.col("th") * 2 / 3))
    return _angled(df, F.col("pose"), 3)


@query("x4_quaternion", with_(VECTOR) + f"SELECT _row, {ANGLES} FROM mat")
def quaternion(spark, sf_dir):
    s = F.sin(F.col("th") / 2)
    df = _poses(spark, sf_dir).withColumn("pose", F.array(F.cos(F.col("th") / 2), s / 3, s * 2 / 3, s * 2 / 3))
    return _angled(df, F.col("pose"), 4)


@query(
    "x5_shift_to_angstrom",
    "SELECT c_custkey, round(c_nationkey * CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN 1.5 END, CASE WHEN c_custkey % 3 = 1 THEN 2.5 END, 3.5) AS DOUBLE), 6) AS shift, round(degrees(c_nationkey / 7.0), 6) AS phase FROM customer",
)
def shift_to_angstrom(spark, sf_dir):
    k = F.col("c_custkey") % 3
    pixel = F.coalesce(F.when(k == 0, F.lit(1.5)), F.when(k == 1, F.lit(2.5)), F.lit(3.5))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_nationkey") * pixel, 6).alias("shift"), F.round(F.degrees(F.col("c_nationkey") / 7.0), 6).alias("phase"))


@query("x6_missing_pose", P("SELECT _row, CASE WHEN _row % 4 > 0 THEN rot ELSE 0.0 END AS rot FROM p"))
def missing_pose(spark, sf_dir):
    return particles(spark, sf_dir).select("_row", F.coalesce(F.when(F.col("_row") % 4 > 0, F.col("rot")), F.lit(0.0)).alias("rot"))


def _coords(spark, sf_dir):
    return [F.col(n) for n in ("x", "y", "psi")], [F.lit(n) for n in (400.0, 500.0, 200.0)], F.lit(1.35), F.lit(4.0)


@query("x7_voxel_to_angstrom", P("SELECT _row, round(((x - 1) * 4 - 200) * 1.35, 6) AS ax, round(((y - 1) * 4 - 250) * 1.35, 6) AS ay, round(((psi - 1) * 4 - 100) * 1.35, 6) AS az, round(x, 6) AS bx, round(y, 6) AS \"by\", round(psi, 6) AS bz, true AS exact FROM p"))
def voxel_to_angstrom(spark, sf_dir):
    v, size, pixel, binning = _coords(spark, sf_dir)
    a = tomo.voxel_to_angstrom(v, size, pixel, binning, one_based=True)
    b = tomo.angstrom_to_voxel(a, size, pixel, binning, one_based=True)
    err = tomo.roundtrip_error(v, size, pixel, binning, one_based=True)
    return particles(spark, sf_dir).select("_row", *[F.round(c, 6).alias(f"a{n}") for c, n in zip(a, "xyz")], *[F.round(c, 6).alias(f"b{n}") for c, n in zip(b, "xyz")], (err < 1e-6).alias("exact"))


@query("x8_axis_orders", P(" UNION ALL ".join(f"SELECT _row, '{o}' AS axes, {['x','y','psi'][o.index('x')]} AS px, {['x','y','psi'][o.index('y')]} AS py, {['x','y','psi'][o.index('z')]} AS pz, 99 - x AS flipped FROM p" for o in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx"))))
def axis_orders(spark, sf_dir):
    p = particles(spark, sf_dir)
    out = None
    for o in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx"):
        x, y, z = tomo.reorder_axes([F.col("x"), F.col("y"), F.col("psi")], o)
        part = p.select("_row", F.lit(o).alias("axes"), x.alias("px"), y.alias("py"), z.alias("pz"), tomo.flip_axis(F.col("x"), F.lit(100.0)).alias("flipped"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "x9_affine_points",
    P("""SELECT _row, round(0.9 * x - 0.2 * y + 5, 6) AS u, round(0.3 * x + 1.1 * y - 7, 6) AS v, round((1.1 * (x - 5) + 0.2 * (y + 7)) / (0.9 * 1.1 + 0.2 * 0.3), 6) AS iu, round((0.9 * (y + 7) - 0.3 * (x - 5)) / (0.9 * 1.1 + 0.2 * 0.3), 6) AS iv,
      x - 3.5 >= 0 AND y - 3.5 >= 0 AND x + 3.5 <= 90 AND y + 3.5 <= 80 AS in_circle, x - 3.5 >= 0 AND x + 3.5 <= 90 AND y - 3.5 >= 0 AND y + 3.5 <= 80 AND psi - 3.5 >= 0 AND psi + 3.5 <= 300 AS in_sphere FROM p"""),
)
def affine_points(spark, sf_dir):
    a = [F.lit(n) for n in (0.9, -0.2, 0.3, 1.1, 5.0, -7.0)]
    x, y = F.col("x"), F.col("y")
    u, v = tomo.apply_affine(x, y, a)
    iu, iv = tomo.invert_affine(x, y, a)
    r, size = F.lit(3.5), [F.lit(90.0), F.lit(80.0), F.lit(300.0)]
    return particles(spark, sf_dir).select(
        "_row", *[F.round(c, 6).alias(n) for c, n in ((u, "u"), (v, "v"), (iu, "iu"), (iv, "iv"))], tomo.circle_inside(x, y, r, size[0], size[1]).alias("in_circle"), tomo.sphere_inside([x, y, F.col("psi")], r, size).alias("in_sphere")
    )


@query(
    "x10_roi",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 3 = 1 THEN p_retailprice / 2 ELSE p_size * 1.35::DOUBLE END AS radius FROM part)
    SELECT p_partkey, radius, CAST(greatest(2, ceil(2 * (radius / 2.7 + 1.5)) + ceil(2 * (radius / 2.7 + 1.5)) % 2) AS INTEGER) AS box FROM r""",
)
def roi(spark, sf_dir):
    k = F.col("p_partkey") % 3
    none = F.lit(None).cast("double")
    radius = tomo.roi_radius(F.when(k == 0, F.col("p_size") * 1.0).otherwise(none), F.when(k == 1, F.col("p_retailprice")).otherwise(none), F.col("p_size"), F.lit(1.35))
    return table(spark, sf_dir, "part").select("p_partkey", radius.alias("radius")).withColumn("box", tomo.storage_box(F.col("radius") / 2.7, 1.5))


@query(
    "x12_defocus_units",
    """WITH v AS (SELECT p_brand, p_retailprice * CASE CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1 ELSE 10 END AS d FROM part),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM v),
    m AS (SELECT p_brand, max(d) FILTER (r = n // 2) AS med FROM o GROUP BY 1),
    u AS (SELECT p_brand, CASE WHEN med < 100 THEN 'micrometer' WHEN med < 9000 THEN 'nm' ELSE 'angstrom' END AS unit FROM m)
    SELECT p_brand, unit, round(sum(d * CASE unit WHEN 'nm' THEN 10 WHEN 'micrometer' THEN 10000 ELSE 1 END), 2) AS total FROM v JOIN u USING (p_brand) GROUP BY ALL""",
)
def defocus_units(spark, sf_dir):
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 3
    v = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") * F.when(brand == 0, F.lit(0.001)).when(brand == 1, F.lit(1.0)).otherwise(F.lit(10.0))).alias("defocus"))
    units = tomo.guess_defocus_unit(v, ["p_brand"])
    return v.join(units, "p_brand").groupBy("p_brand", "unit").agg(F.round(F.sum(tomo.defocus_to_angstrom(F.col("defocus"), F.col("unit"))), 2).alias("total"))


@query(
    "x15_elapsed",
    """WITH t AS (SELECT event_id, greatest(CAST(trunc(value * 10007 - 5000) AS BIGINT), 0) AS s FROM events)
    SELECT event_id, s // 86400 AS days, s % 86400 // 3600 AS hours, s % 3600 // 60 AS minutes, s % 60 AS seconds FROM t""",
)
def elapsed(spark, sf_dir):
    parts = logs.elapsed_parts((F.col("value") * 10007 - 5000).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "x16_step_phase",
    """WITH s AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN '01_randomize_halves' WHEN 1 THEN '01_other' WHEN 9 THEN NULL ELSE '0' || CAST(event_id % 10 AS VARCHAR) || '_step' || event_type END AS step FROM events)
    SELECT event_id, step, CAST(CASE WHEN step LIKE '01!_randomize!_halves%' ESCAPE '!' THEN 1 WHEN step[1:3] IN ('04_', '05_') THEN 3 WHEN step[1:3] IN ('06_', '07_', '08_') THEN 4 END AS INTEGER) AS phase FROM s""",
)
def step_phase(spark, sf_dir):
    d = F.col("event_id") % 10
    step = F.when(d == 0, "01_randomize_halves").when(d == 1, "01_other").when(d == 9, F.lit(None)).otherwise(F.concat(F.lit("0"), d.cast("string"), F.lit("_step"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", step.alias("step")).withColumn("phase", logs.step_phase(F.col("step")))


@query(
    "x17_cell_text",
    r"""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '?' ELSE regexp_replace(regexp_replace(printf('%.6f', c_acctbal / 8), '0+$', ''), '\.$', '') END AS number, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END AS flag, CAST(c_nationkey AS VARCHAR) AS whole,
      CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE replace(c_mktsegment || ' x', ' ', '_') END AS text FROM customer""",
)
def cell_text(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 8).alias("number"), (k % 2 == 0).alias("flag"), F.col("c_nationkey").alias("whole"),
        F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat("c_mktsegment", F.lit(" \t x"))).alias("text"),
    )
    return df.select("c_custkey", *[cells.cell_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema if f.name != "c_custkey"])


@query("x18_tomogram_size", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN round_even(p_size * 2.5, 0) WHEN p_partkey % 3 = 1 THEN p_size + 1000 ELSE 0 END AS INTEGER) AS size FROM part")
def tomogram_size(spark, sf_dir):
    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", tomo.tomogram_size(F.when(k == 0, F.col("p_size")), F.lit(2.5), F.when(k == 1, F.col("p_size") + 1000)).alias("size"))


@query("x_true_words", "SELECT doc_id, lower(trim(lang)) IN ('true', 't', 'yes', 'y', '1', 'on') AS a, (quality = 1) AS b FROM documents JOIN labels USING (doc_id)")
def true_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", keys.is_true_word(F.col("lang")).alias("a"), keys.is_true_word(F.when(F.col("quality") == 1, F.lit(" Yes ")).otherwise(F.lit("off"))).alias("b"))


# --- tilt geometry: tomograms are regions, tilts their nations, picks their customers ---

GEOMETRY = """tl AS (SELECT n_regionkey AS tomo, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS tilt_index, n_nationkey * 4.0 - 50 AS ang, 1.0 + n_nationkey / 100.0 AS a11, n_nationkey / 50.0 AS a12, n_nationkey / -60.0 AS a21, 1.0 - n_nationkey / 200.0 AS a22, n_nationkey * 0.5 AS dx, n_nationkey * -0.25 AS dy FROM nation),
g AS (SELECT *, cos(radians(ang)) AS ca, sin(radians(ang)) AS sa, a11 * a22 - a12 * a21 AS det FROM tl WHERE NOT (tilt_index = 2 OR (tilt_index BETWEEN 4 AND 5 AND tomo = 1))),
k AS (SELECT *, a22 / det AS i11, -a12 / det AS i12, -a21 / det AS i21, a11 / det AS i22 FROM g),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY tomo ORDER BY tilt_index) AS INTEGER) AS frame FROM k)"""
# World point (X, Y, Z) through flip, offset (2, 1, 0), origin (-1, -30, -1), tilt about (40, 50), then the affine.
IMAGE = """(i11 * u + i12 * v) * 2 + 41 - (i11 * (dx + 40) + i12 * (dy + 50)) AS ali_x, (i21 * u + i22 * v) * 2 + 52 - (i21 * (dx + 40) + i22 * (dy + 50)) AS ali_y"""


def _tilts(spark, sf_dir):
    from pyspark.sql import Window

    n = F.col("n_nationkey")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    consts = {"ox": 41.0, "oy": 52.0, "cx": 40.0, "cy": 50.0, "binning": 2.0, "thickness": 60.0, "shift_x": 1.0, "shift_y": 2.0, "off_x": 3.0, "off_y": 3.0, "off_z": 0.0}
    return table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("tomo"), F.row_number().over(w).alias("tilt_index"), (n * 4.0 - 50).alias("tilt_angle"), (1.0 + n / 100.0).alias("a11"), (n / 50.0).alias("a12"), (n / -60.0).alias("a21"),
        (1.0 - n / 200.0).alias("a22"), (n * 0.5).alias("dx"), (n * -0.25).alias("dy"), *[F.lit(v).alias(c) for c, v in consts.items()],
    )


def _matrices(spark, sf_dir, flip="none"):
    lists = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tomo"), F.lit(5).alias("n"), F.when(F.col("r_regionkey") == 1, F.lit("2,5-4  trailing")).otherwise(F.lit("2")).alias("listing"))
    return tomo.tilt_matrices(_tilts(spark, sf_dir), ["tomo"], flip=flip, excluded=tomo.excluded_tilts(lists, ["tomo"], "listing", "n"))


@query(
    "x11_excluded_tilts",
    "SELECT r_regionkey AS tomo, CAST(t AS INTEGER) AS tilt_index FROM region, (SELECT unnest([2, 4, 5]) AS t) WHERE t = 2 OR r_regionkey = 1",
)
def excluded_tilts(spark, sf_dir):
    lists = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tomo"), F.lit(5).alias("n"), F.when(F.col("r_regionkey") == 1, F.lit("2,5-4  trailing")).otherwise(F.lit("2")).alias("listing"))
    return tomo.excluded_tilts(lists, ["tomo"], "listing", "n")


# First image row: M = A * T * O * Off, written out for the unflipped case.
@query(
    "x11_tilt_matrices",
    with_(GEOMETRY)
    + """SELECT tomo, tilt_index, frame, round(2 * i11 * ca, 6) AS m00, round(2 * -i11 * sa, 6) AS m01, round(2 * i12, 6) AS m02,
      round(2 * i11 * (ca * 1 + sa * 29 + 40 - ca * 40) + 2 * i12 * -1 + 41 - i11 * (dx + 40) - i12 * (dy + 50), 6) AS m03,
      round(2 * i21 * ca, 6) AS m10, round(2 * i22, 6) AS m12 FROM f""",
)
def tilt_matrices(spark, sf_dir):
    m = _matrices(spark, sf_dir)
    return m.select("tomo", "tilt_index", "frame", *[F.round(c, 6).alias(c) for c in ("m00", "m01", "m02", "m03", "m10", "m12")])


def _sql_product(a, b):
    """Product of two 4 x 4 lists of lists."""
    return f"[[list_sum([{a}[i][k] * {b}[k][j] FOR k IN range(1, 5)]) FOR j IN range(1, 5)] FOR i IN range(1, 5)]"


def _sql_shift(x, y, z):
    return f"[[1.0::DOUBLE, 0, 0, {x}], [0, 1, 0, {y}], [0, 0, 1, {z}], [0, 0, 0, 1]]"


# Image from world: scaled affine, tilt about the second axis, origin, offset, and one of three flips.
WHOLE = f""", a1 AS (SELECT *, [[i11::DOUBLE, i12, 0, -(i11 * dx + i12 * dy)], [i21, i22, 0, -(i21 * dx + i22 * dy)], [0, 0, 1, 0], [0, 0, 0, 1]] AS n, {_sql_shift(41, 52, 0)} AS o, {_sql_shift(-40, -50, 0)} AS c,
    [[ca::DOUBLE, -sa, 0, 40], [0, 0, 1, 50], [-sa, -ca, 0, 0], [0, 0, 0, 1]] AS t, {_sql_shift(-40, 0, -50)} AS tc, {_sql_shift(-1, -30, -1)} AS w, {_sql_shift(2, 1, 0)} AS s FROM f),
  a2 AS (SELECT *, {_sql_product("o", "n")} AS p, {_sql_product("t", "tc")} AS q, {_sql_product("w", "s")} AS r FROM a1),
  a3 AS (SELECT *, {_sql_product("p", "c")} AS p3 FROM a2),
  a4 AS (SELECT *, [[CASE WHEN i < 4 AND j < 4 THEN 2 * p3[i][j] ELSE p3[i][j] END FOR j IN range(1, 5)] FOR i IN range(1, 5)] AS a FROM a3),
  a5 AS (SELECT *, {_sql_product("a", "q")} AS aq FROM a4),
  a6 AS (SELECT *, {_sql_product("aq", "r")} AS aqr FROM a5),
  fl(flip, m) AS (VALUES ('none', {_sql_shift(0, 0, 0)}), ('yz', [[1.0::DOUBLE, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1]]), ('yz_z', [[1.0::DOUBLE, 0, 0, 0], [0, 0, -1, 59], [0, 1, 0, 0], [0, 0, 0, 1]])),
  a7 AS (SELECT tomo, flip, tilt_index, frame, {_sql_product("aqr", "m")} AS e FROM a6, fl)"""
ENTRIES = [(i, j) for i in range(4) for j in range(4)]


@query(
    "x11_whole_matrices",
    with_(GEOMETRY) + WHOLE + " SELECT tomo, flip, tilt_index, frame, " + ", ".join(f"round(e[{i + 1}][{j + 1}], 6) + 0.0 AS m{i}{j}" for i, j in ENTRIES) + " FROM a7",
)
def whole_matrices(spark, sf_dir):
    """All sixteen entries for each of the three flips."""
    out = None
    for flip in ("none", "yz", "yz_z"):
        m = _matrices(spark, sf_dir, flip).select("tomo", F.lit(flip).alias("flip"), "tilt_index", "frame", *[(F.round(f"m{i}{j}", 6) + 0.0).alias(f"m{i}{j}") for i, j in ENTRIES])
        out = m if out is None else out.unionByName(m)
    return out


@query(
    "j16_project_picks",
    with_(GEOMETRY)
    + f""", pk AS (SELECT c_custkey AS particle, n_regionkey AS tomo, c_custkey % 80 * 1.0 AS x, c_custkey % 90 * 1.0 AS y, c_custkey % 40 * 1.0 AS z FROM customer JOIN nation ON c_nationkey = n_nationkey),
    wp AS (SELECT *, x * 0.5 + 2 - 1 AS wx, z * 0.5 + 1 - 30 AS wy, y * 0.5 - 1 AS wz FROM pk JOIN f USING (tomo)),
    im AS (SELECT *, ca * (wx - 40) - sa * wy + 40 AS u, wz AS v FROM wp),
    al AS (SELECT *, {IMAGE} FROM im)
    SELECT tomo, particle, tilt_index, round(ali_x, 5) AS ali_x, round(ali_y, 5) AS ali_y, round((a22 * (ali_x - dx) - a12 * (ali_y - dy)) / det, 5) AS raw_x, round((a11 * (ali_y - dy) - a21 * (ali_x - dx)) / det, 5) AS raw_y,
      ali_x BETWEEN 0 AND 80 AND ali_y BETWEEN 0 AND 100 AS visible FROM al""",
)
def project_picks(spark, sf_dir):
    k = F.col("c_custkey")
    picks = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("particle"), F.col("n_regionkey").alias("tomo"), (k % 80 * 1.0).alias("x"), (k % 90 * 1.0).alias("y"), (k % 40 * 1.0).alias("z"),
        F.lit(0.5).alias("pick_binning"), F.lit(4.0).alias("radius"), F.lit(80.0).alias("nx"), F.lit(100.0).alias("ny"),
    )
    out = tomo.project_picks(picks, _matrices(spark, sf_dir), ["tomo"])
    return out.select("tomo", "particle", "tilt_index", *[F.round(c, 5).alias(c) for c in ("ali_x", "ali_y", "raw_x", "raw_y")], "visible")
