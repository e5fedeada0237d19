"""Ready-made Fourier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.functions import optics
from motes.operators import fourier as ops
from motes.plans.registry import query
from motes.plans.standins import COEFFICIENTS, VOLUME_COEFFICIENTS, coefficients, table, volume_coefficients, with_


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _halves(df):
    return df.filter("half = 1"), df.filter("half = 2")


# Shell curve of both halves of every pair; {t} table, {b} bins, {d} size times pixel size.
def curve_sql(t: str, bins: int, span: float, name: str = "fsc") -> str:
    return f""", mx AS (SELECT max(kz * kz + ky * ky + kx * kx) AS m FROM {t}),
a1 AS (SELECT * FROM {t} WHERE half = 1), b1 AS (SELECT * FROM {t} WHERE half = 2),
sc AS (SELECT pair, CAST(floor(sqrt((kz * kz + ky * ky + kx * kx) * {bins * bins} / CAST(m AS DOUBLE))) AS INTEGER) AS shell, a1.re * b1.re + a1.im * b1.im AS n, a1.re ** 2 + a1.im ** 2 AS p, b1.re ** 2 + b1.im ** 2 AS q
  FROM a1 JOIN b1 USING (pair, kz, ky, kx), mx),
sums AS (SELECT pair, shell, sum(n) / (sqrt(sum(p) * sum(q)) + 1e-12) AS fsc FROM sc WHERE shell < {bins} GROUP BY 1, 2),
{name} AS (SELECT pair, CAST(shell AS INTEGER) AS shell, (shell + 0.5) * sqrt(m) / {bins * span} AS frequency, fsc
  FROM (SELECT pair, CAST(shell AS INTEGER) AS shell, m FROM (SELECT DISTINCT pair FROM a1), range({bins}) r(shell), mx) LEFT JOIN sums USING (pair, shell))"""


@query("a22_ring_correlation", with_(COEFFICIENTS) + curve_sql("co", 4, 12.0) + " SELECT pair, shell, round(frequency, 9) AS frequency, round(fsc, 6) AS fsc FROM fsc")
def ring_correlation(spark, sf_dir):
    a, b = _halves(coefficients(spark, sf_dir))
    return _rounded(_rounded(ops.shell_correlation(a, b, ["pair"], 4, 8, 1.5), ["fsc"]), ["frequency"], 9)


@query("a22_shell_correlation_empty_zero", with_(VOLUME_COEFFICIENTS) + curve_sql("cv", 16, 6.0) + " SELECT pair, shell, round(frequency, 9) AS frequency, round(coalesce(fsc, 0), 6) AS fsc FROM fsc")
def shell_correlation(spark, sf_dir):
    a, b = _halves(volume_coefficients(spark, sf_dir))
    return _rounded(_rounded(ops.shell_correlation(a, b, ["pair"], 16, 4, 1.5, empty=0.0), ["fsc"]), ["frequency"], 9)


@query("a23_signal_to_noise", with_(COEFFICIENTS) + curve_sql("co", 4, 12.0) + " SELECT pair, shell, round(least(0.99, greatest(0, fsc)) / greatest(1 - least(0.99, greatest(0, fsc)), 1e-6), 5) AS snr FROM fsc")
def signal_to_noise(spark, sf_dir):
    a, b = _halves(coefficients(spark, sf_dir))
    return _rounded(ops.signal_to_noise(ops.shell_correlation(a, b, ["pair"], 4, 8, 1.5)).select("pair", "shell", "snr"), ["snr"], 5)


@query(
    "a24_amplitude_falloff",
    with_(COEFFICIENTS)
    + """, sh AS (SELECT map, least(floor(sqrt(ky * ky + kx * kx) * 2), 7) AS shell, avg(sqrt(re * re + im * im)) AS a FROM co GROUP BY ALL),
    f AS (SELECT map, ((shell + 0.5) * (0.5 / 1.5 / 8)) ** 2 AS x, ln(a) AS y FROM sh WHERE a > 0 AND 1 / ((shell + 0.5) * (0.5 / 1.5 / 8)) BETWEEN 3.5 AND 30)
    SELECT map, round(corr(x, y) ** 2, 6) AS amplitude_score FROM f GROUP BY 1""",
)
def amplitude_falloff(spark, sf_dir):
    return _rounded(ops.amplitude_falloff(coefficients(spark, sf_dir), ["map"], 8, 1.5, F.lit(30.0), F.lit(3.5)), ["amplitude_score"])


# The smallest eigenvalue as the lowest root of the characteristic polynomial, trigonometric form.
EIGEN = """least(greatest(3 * CASE WHEN p2 > 1e-300 THEN q + 2 * sqrt(p2) * cos(acos(least(1, greatest(-1,
  (((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (2 * p2 * sqrt(p2)))))) / 3 + 2 * pi() / 3) ELSE q END, 0), 1)"""


def moments_sql(source: str, group: str, band: str) -> str:
    p = "(re * re + im * im)"
    r = "(kz * kz + ky * ky + kx * kx)"
    terms = {"xx": "kx*kx", "yy": "ky*ky", "zz": "kz*kz", "xy": "kx*ky", "xz": "kx*kz", "yz": "ky*kz"}
    sums = ", ".join(f"sum({p} * {t} / {r}) / sum({p}) AS {n}" for n, t in terms.items())
    return f"""SELECT *, ((xx-q)**2 + (yy-q)**2 + (zz-q)**2 + 2 * (xy*xy + xz*xz + yz*yz)) / 6 AS p2 FROM (SELECT *, (xx + yy + zz) / 3 AS q FROM (
      SELECT {group}, {sums} FROM {source} WHERE {r} > 0 AND {band} GROUP BY {group}))"""


@query(
    "a25_direction_isotropy",
    with_(VOLUME_COEFFICIENTS) + ", m AS (" + moments_sql("cv", "map", "sqrt(kz*kz + ky*ky + kx*kx) / 6.0 BETWEEN 0.15 AND 0.4") + f") SELECT map, round({EIGEN}, 5) AS isotropy_score FROM m",
)
def direction_isotropy(spark, sf_dir):
    out = ops.direction_isotropy(volume_coefficients(spark, sf_dir), ["map"], F.lit(0.15), F.lit(0.4), 4, 1.5, fallback=None)
    return _rounded(out, ["isotropy_score"], 5)


@query(
    "a26_half_map_quality",
    with_(VOLUME_COEFFICIENTS)
    + curve_sql("cv", 4, 6.0, "raw")
    + """, fsc AS (SELECT *, lead(fsc) OVER w AS y2, lead(frequency) OVER w AS f2 FROM raw WHERE fsc IS NOT NULL WINDOW w AS (PARTITION BY pair ORDER BY shell)),
    cr AS (SELECT pair, arg_min(frequency + (fsc - 0.143) / (fsc - y2) * (f2 - frequency), shell) AS f FROM fsc WHERE fsc >= 0.143 AND y2 < 0.143 GROUP BY 1),
    ct AS (SELECT pair, coalesce(any_value(f), max(frequency) FILTER (fsc > 0.143), max(frequency)) AS res FROM fsc LEFT JOIN cr USING (pair) GROUP BY 1),
    cut AS (SELECT *, least(res, 0.5 / 1.5) AS cut FROM ct),
    s1 AS (SELECT pair, sum(fsc * frequency ** 2) / sum(frequency ** 2) AS s FROM fsc JOIN cut USING (pair) WHERE frequency <= cut GROUP BY 1),
    mean AS (SELECT pair, kz, ky, kx, avg(re) AS re, avg(im) AS im, any_value(res) AS res, any_value(cut) AS cut FROM cv JOIN cut USING (pair) GROUP BY ALL HAVING count(*) = 2),
    sh AS (SELECT pair, res, least(floor(sqrt(kz*kz + ky*ky + kx*kx) * 2), 3) AS shell, avg(sqrt(re * re + im * im)) AS a FROM mean GROUP BY ALL),
    fit AS (SELECT pair, ((shell + 0.5) * (0.5 / 1.5 / 4)) ** 2 AS x, ln(a) AS y, 1 / ((shell + 0.5) * (0.5 / 1.5 / 4)) BETWEEN 1 / res AND greatest(2 / res, 1 / res + 2, 8) AS inb FROM sh),
    s2 AS (SELECT pair, CASE WHEN count(*) FILTER (inb) < 3 THEN 1.0 ELSE corr(x, y) FILTER (inb) ** 2 END AS s FROM fit GROUP BY 1),
    m AS ("""
    + moments_sql("mean", "pair", "sqrt(kz*kz + ky*ky + kx*kx) / 6.0 >= 0.66 * 0.5 / 1.5")
    + f"""), s3 AS (SELECT pair, {EIGEN} AS s FROM m)
    SELECT pair, round(1 / res, 5) AS resolution, round(s1.s, 5) AS fsc_score, round(s2.s, 5) AS amplitude_score, round(s3.s, 5) AS isotropy_score,
      round((greatest(s1.s, 1e-8) * greatest(s2.s, 1e-8) * greatest(s3.s, 1e-8)) ** (1.0 / 3), 5) AS score
    FROM cut JOIN s1 USING (pair) JOIN s2 USING (pair) JOIN s3 USING (pair)""",
)
def half_map_quality(spark, sf_dir):
    out = ops.half_map_quality(*_halves(volume_coefficients(spark, sf_dir)), ["pair"], 4, 1.5, 4)
    return _rounded(out, [c for c in out.columns if c != "pair"], 5)


@query(
    "a27_equalise_amplitudes",
    with_(COEFFICIENTS)
    + """, m AS (SELECT ky, kx, avg(sqrt(re * re + im * im)) AS a FROM co GROUP BY ALL)
    SELECT map, ky, kx, round(coalesce(re * (a / nullif(sqrt(re * re + im * im), 0)), 0), 6) AS re, round(coalesce(im * (a / nullif(sqrt(re * re + im * im), 0)), 0), 6) AS im FROM co JOIN m USING (ky, kx)""",
)
def equalise_amplitudes(spark, sf_dir):
    return _rounded(ops.equalise_amplitudes(coefficients(spark, sf_dir)).select("map", "ky", "kx", "re", "im"), ["re", "im"])


POSES = "poses AS (SELECT vec_id AS map, (vec_id * 37) % 360 + 0.37 AS rot, (vec_id * 53) % 180 + 0.21 AS tilt, (vec_id * 11) % 360 + 0.11 AS psi, CAST(vec_id % 2 + 1 AS INTEGER) AS subset FROM embeddings)"


@query(
    "a28_scatter_add",
    with_(COEFFICIENTS, POSES)
    + """, a AS (SELECT *, radians(rot) AS a, radians(tilt) AS b, radians(psi) AS g FROM co JOIN poses USING (map)),
    t AS (SELECT subset, re, im, (cos(a)*cos(b)*cos(g) - sin(a)*sin(g))*kx + (-cos(a)*cos(b)*sin(g) - sin(a)*cos(g))*ky AS x,
      (sin(a)*cos(b)*cos(g) + cos(a)*sin(g))*kx + (-sin(a)*cos(b)*sin(g) + cos(a)*cos(g))*ky AS y, (-sin(b)*cos(g))*kx + (sin(b)*sin(g))*ky AS z FROM a WHERE re <> 0 OR im <> 0),
    f AS (SELECT subset, re, CASE WHEN x < 0 THEN -im ELSE im END AS im, CAST(round_even(CASE WHEN x < 0 THEN -x ELSE x END, 0) AS INTEGER) AS x, CAST(round_even(CASE WHEN x < 0 THEN -y ELSE y END, 0) AS INTEGER) AS y, CAST(round_even(CASE WHEN x < 0 THEN -z ELSE z END, 0) AS INTEGER) AS z FROM t)
    SELECT subset, CAST((z + 8) % 8 AS INTEGER) AS iz, CAST((y + 8) % 8 AS INTEGER) AS iy, CAST((x + 8) % 8 AS INTEGER) AS ix, count(*) AS weight, round(sum(re) / (count(*) + 1e-8), 6) AS re, round(sum(im) / (count(*) + 1e-8), 6) AS im
    FROM f WHERE abs(x) <= 4 AND abs(y) <= 4 AND abs(z) <= 4 GROUP BY 1, 2, 3, 4""",
)
def scatter_add(spark, sf_dir):
    v = F.col("vec_id")
    poses = table(spark, sf_dir, "embeddings").select(
        v.alias("map"), ((v * 37) % 360 + 0.37).alias("rot"), ((v * 53) % 180 + 0.21).alias("tilt"), ((v * 11) % 360 + 0.11).alias("psi"), (v % 2 + 1).cast("int").alias("subset")
    )
    return _rounded(ops.scatter_add(coefficients(spark, sf_dir), poses, ["subset"], 8, image="map"), ["re", "im"])


@query("a36_sharpen", with_(COEFFICIENTS) + "SELECT map, ky, kx, round(re * exp(-80.0 / 4 * (ky*ky + kx*kx) / 144.0), 7) AS re, round(im * exp(-80.0 / 4 * (ky*ky + kx*kx) / 144.0), 7) AS im FROM co")
def sharpen(spark, sf_dir):
    return _rounded(ops.sharpen(coefficients(spark, sf_dir), 80.0, 8, 1.5).select("map", "ky", "kx", "re", "im"), ["re", "im"], 7)


@query(
    "a36_low_pass",
    with_(COEFFICIENTS)
    + """, w AS (SELECT *, sqrt(ky*ky + kx*kx) / 12.0 AS s FROM co), v AS (SELECT *, CASE WHEN s > 0.25 + 1 / 6.0 THEN 0 WHEN s >= 0.25 - 1 / 6.0 THEN 0.5 * (1 + cos(pi() * (s - (0.25 - 1 / 6.0)) / (1 / 3.0))) ELSE 1 END AS f FROM w)
    SELECT map, ky, kx, round(re * f, 7) AS re, round(im * f, 7) AS im FROM v""",
)
def low_pass(spark, sf_dir):
    return _rounded(ops.low_pass(coefficients(spark, sf_dir), 4.0, 8, 1.5).select("map", "ky", "kx", "re", "im"), ["re", "im"], 7)


@query(
    "a36_weight_by_curve",
    with_(COEFFICIENTS)
    + curve_sql("co", 4, 12.0)
    + """, l AS (SELECT pair, greatest(coalesce(min(shell) FILTER (fsc < 1e-4), 4) - 1, 0) AS last, min(frequency) FILTER (shell = 0) AS f0, min(frequency) FILTER (shell = 1) - min(frequency) FILTER (shell = 0) AS step,
      list(fsc ORDER BY shell) AS f FROM fsc GROUP BY 1),
    c AS (SELECT map, ky, kx, re, im, sqrt(ky*ky + kx*kx) / 12.0 AS s, f0 + step * last AS cut, least(greatest((sqrt(ky*ky + kx*kx) / 12.0 - f0) / step, 0), 3) AS at0, f FROM co JOIN l USING (pair)),
    d AS (SELECT *, CAST(least(floor(at0), 2) AS INTEGER) AS lo FROM c),
    e AS (SELECT *, f[lo + 1] + (at0 - lo) * (f[lo + 2] - f[lo + 1]) AS y FROM d)
    SELECT map, ky, kx, round(CASE WHEN s <= cut AND y > 0 THEN re * sqrt(2 * y / (1 + y)) ELSE 0 END, 6) AS re, round(CASE WHEN s <= cut AND y > 0 THEN im * sqrt(2 * y / (1 + y)) ELSE 0 END, 6) AS im FROM e""",
)
def weight_by_curve(spark, sf_dir):
    co = coefficients(spark, sf_dir)
    curve = ops.shell_correlation(*_halves(co), ["pair"], 4, 8, 1.5)
    return _rounded(ops.weight_by_curve(co, curve, ["pair"], 8, 1.5).select("map", "ky", "kx", "re", "im"), ["re", "im"])


@query(
    "a37_swap_amplitudes",
    with_(COEFFICIENTS)
    + """SELECT a.pair, a.ky, a.kx, round(coalesce(a.re * (sqrt(b.re**2 + b.im**2) / nullif(sqrt(a.re**2 + a.im**2), 0)), 0), 6) AS re, round(coalesce(a.im * (sqrt(b.re**2 + b.im**2) / nullif(sqrt(a.re**2 + a.im**2), 0)), 0), 6) AS im
    FROM co a JOIN co b USING (pair, ky, kx) WHERE a.half = 1 AND b.half = 2""",
)
def swap_amplitudes(spark, sf_dir):
    out = ops.swap_amplitudes(*_halves(coefficients(spark, sf_dir)), ["pair"])
    return _rounded(out.select("pair", "ky", "kx", "re", "im"), ["re", "im"])


OPTICS = """op AS (SELECT *, CASE WHEN map % 17 = 3 THEN 'nan'::DOUBLE ELSE 300.0 END AS volt, 12000.0 + map % 50 * 100 AS du, 11500.0 + map % 30 * 100 AS dv, CAST(map % 180 AS DOUBLE) AS da, kx / 12.0 AS fx, ky / 12.0 AS fy FROM co),
lam AS (SELECT *, 12.2643247 / sqrt(volt * 1e3 * (1 + volt * 1e3 * 0.978466e-6)) AS l FROM op),
ctf AS (SELECT *, CASE WHEN isnan(volt) THEN 1.0 ELSE -sin(pi() * l * (-(du + dv) / 2 - (du - dv) / 2 * cos(2 * (atan2(fy, fx) - da * pi() / 180))) * (fx * fx + fy * fy) + pi() / 2 * 2.7e7 * l * l * l * (fx * fx + fy * fy) ** 2 - 10 * pi() / 180 - atan(0.1 / sqrt(1 - 0.1 * 0.1))) * exp(-50.0 / 4 * (fx * fx + fy * fy)) END AS c FROM lam)"""


def _transfer(df):
    m = F.col("map")
    volt = F.when(m % 17 == 3, F.lit(float("nan"))).otherwise(F.lit(300.0))
    c = optics.contrast_transfer(
        F.col("kx") / 12.0, F.col("ky") / 12.0, volt, 12000.0 + m % 50 * 100, 11500.0 + m % 30 * 100, (m % 180).cast("double"),
        F.lit(2.7), F.lit(50.0), F.lit(10.0), F.lit(0.1),
    )
    return df.withColumn("c", c)


@query("x13_contrast_transfer", with_(COEFFICIENTS, OPTICS) + "SELECT map, ky, kx, round(c, 6) AS c FROM ctf")
def contrast_transfer(spark, sf_dir):
    return _rounded(_transfer(coefficients(spark, sf_dir)).select("map", "ky", "kx", "c"), ["c"])


@query(
    "x13_transfer_modes",
    with_(COEFFICIENTS, OPTICS) + "SELECT map, ky, kx, CAST(sign(c) AS DOUBLE) * re AS flipped, round(re * c, 7) AS modulated, round(re * (c / (c * c + 0.1)), 6) AS wiener FROM ctf",
)
def transfer_modes(spark, sf_dir):
    df = _transfer(coefficients(spark, sf_dir))
    w = {m: optics.transfer_weight(F.col("c"), m, 0.1) for m in ("sign", "multiply", "wiener")}
    return df.select("map", "ky", "kx", (w["sign"] * F.col("re")).alias("flipped"), F.round(F.col("re") * w["multiply"], 7).alias("modulated"), F.round(F.col("re") * w["wiener"], 6).alias("wiener"))


@query(
    "x14_shift_phase",
    with_(COEFFICIENTS)
    + """, s AS (SELECT *, -2 * pi() * (kx * (map % 7 * 0.5) + ky * (map % 5 * 0.25)) / 8.0 AS a FROM co)
    SELECT map, ky, kx, round(re * cos(a) - im * sin(a), 7) AS re, round(re * sin(a) + im * cos(a), 7) AS im FROM s""",
)
def shift_phase(spark, sf_dir):
    m = F.col("map")
    re, im = optics.shift_phase(F.col("re"), F.col("im"), F.col("kx"), F.col("ky"), m % 7 * 0.5, m % 5 * 0.25, 8)
    return coefficients(spark, sf_dir).select("map", "ky", "kx", F.round(re, 7).alias("re"), F.round(im, 7).alias("im"))
