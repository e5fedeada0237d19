"""Reductions and edits of Fourier coefficient tables ``(map, kz, ky, kx, re, im)``.

Indices are centred whole numbers; physical frequencies are index / (size * pixel size).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.functions.angles import matrix_from_zyz
from motes.session import checkpointed

K = ("kz", "ky", "kx")


def radius2() -> Column:
    """Squared index radius, a whole number."""
    return sum((F.col(k).cast("bigint") * F.col(k) for k in K[1:]), F.col("kz").cast("bigint") * F.col("kz"))


def _shell(bins: int, largest: Column) -> Column:
    """Shell number out of ``bins`` up to the largest radius, which itself is left out.

    The root of a ratio of whole numbers is exact where it is whole, so coefficients on a
    shell border always fall to the upper shell.
    """
    at = F.floor(F.sqrt(radius2() * F.lit(bins * bins) / largest)).cast("int")
    return F.when(at < bins, at)


def shell_correlation(
    a: DataFrame, b: DataFrame, keys: Sequence[str], bins: int, size: int, pixel: float, eps: float = 1e-12, empty: float | None = None
) -> DataFrame:
    """Correlation of two coefficient tables per shell (rings for planar tables).

    Every shell has a row; one without coefficients is NULL or ``empty``.
    """
    keys = list(keys)
    heads = a.groupBy(*keys).agg(F.max(radius2()).alias("_radius2"))  # a row a key, for the largest radius and for the keys
    largest = heads.agg(F.max("_radius2").alias("_radius2")).scalar()
    both = a.select(*keys, *K, "re", "im").join(
        b.select(*keys, *K, F.col("re").alias("re2"), F.col("im").alias("im2")), [*keys, *K]
    )
    sums = (
        both.withColumn("shell", _shell(bins, largest))
        .filter("shell is not null")
        .groupBy(*keys, "shell")
        .agg(
            F.sum(F.col("re") * F.col("re2") + F.col("im") * F.col("im2")).alias("_n"),
            F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_a"),
            F.sum(F.col("re2") * F.col("re2") + F.col("im2") * F.col("im2")).alias("_b"),
        )
    )
    value = F.col("_n") / (F.sqrt(F.col("_a") * F.col("_b")) + F.lit(eps))
    grid = heads.select(*keys).withColumn("shell", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = F.sqrt(largest) / F.lit(bins * size * pixel)
    return grid.join(sums, [*keys, "shell"], "left").select(
        *keys,
        "shell",
        ((F.col("shell") + 0.5) * step).alias("frequency"),
        F.coalesce(value, F.lit(empty)).alias("fsc") if empty is not None else value.alias("fsc"),
    )


def signal_to_noise(curve: DataFrame) -> DataFrame:
    """Signal-to-noise per shell from a correlation curve."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("fsc")))
    return curve.withColumn("snr", f / F.greatest(1 - f, F.lit(1e-6)))


def amplitude_falloff(df: DataFrame, keys: Sequence[str], size: int, pixel: float, min_res: Column, max_res: Column) -> DataFrame:
    """How straight the log amplitude falls with squared frequency inside a resolution band.

    Squared correlation over shells with ``max_res <= d <= min_res`` (no upper end when
    ``max_res`` is 0); neutral 1 with fewer than three shells.
    """
    # shells split [0, Nyquist] into `size` parts; the rest falls into the last one
    at = F.least(F.floor(F.sqrt(radius2()) * 2), F.lit(size - 1)).cast("int")
    shells = df.groupBy(*keys, at.alias("shell")).agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("_a"))
    s = (F.col("shell") + 0.5) * F.lit(0.5 / pixel / size)
    band = (1 / s <= min_res) & (1 / s >= max_res) & (F.col("_a") > 0)
    fit = shells.withColumn("_x", F.when(band, s * s)).withColumn("_y", F.when(band, F.ln("_a")))
    r = F.corr("_x", "_y")
    return fit.groupBy(*keys).agg(
        F.when(F.count(F.col("_x") + F.col("_y")) < 3, F.lit(1.0)).otherwise(F.coalesce(F.nanvl(r * r, F.lit(0.0)), F.lit(0.0))).alias("amplitude_score")
    )


def add_least_eigenvalue(df: DataFrame, out: str, xx="xx", yy="yy", zz="zz", xy="xy", xz="xz", yz="yz") -> DataFrame:
    """Smallest eigenvalue of a symmetric 3 x 3 matrix in closed form, step by step so that
    no intermediate value is computed twice."""
    c = {n: F.col(v) for n, v in {"xx": xx, "yy": yy, "zz": zz, "xy": xy, "xz": xz, "yz": yz}.items()}
    step = df.withColumn("_q", (c["xx"] + c["yy"] + c["zz"]) / 3)
    step = step.withColumns({f"_d{n}": c[n] - F.col("_q") for n in ("xx", "yy", "zz")})
    dx, dy, dz = (F.col(f"_d{n}") for n in ("xx", "yy", "zz"))
    off = c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"]
    step = step.withColumn("_p2", (dx * dx + dy * dy + dz * dz + 2 * off) / 6)
    det = dx * (dy * dz - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * dz - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - dy * c["xz"])
    step = step.withColumn("_det", det / (2 * F.col("_p2") * F.sqrt("_p2")))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_det")))) / 3 + 2 * math.pi / 3
    value = F.when(F.col("_p2") > 1e-300, F.col("_q") + 2 * F.sqrt("_p2") * F.cos(angle)).otherwise(F.col("_q"))
    return step.withColumn(out, value).drop("_q", "_dxx", "_dyy", "_dzz", "_p2", "_det")


def direction_isotropy(df: DataFrame, keys: Sequence[str], low: Column, high: Column, size: int, pixel: float, fallback: float | None = 100) -> DataFrame:
    """How evenly the power in a frequency band spreads over directions, 0 to 1.

    Three times the smallest eigenvalue of the power-weighted second moments of unit
    directions. A band with fewer than ``fallback`` coefficients is replaced by the upper
    third of the spectrum; without power the result is a neutral 1.
    """
    s = F.sqrt(radius2()) / F.lit(size * pixel)
    placed = df.withColumn("_s", s).filter("_s > 0")
    band = (F.col("_s") >= low) & (F.col("_s") <= high)
    upper = F.col("_s") >= 0.66 * 0.5 / pixel
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    r2 = radius2()
    pairs = {"xx": ("kx", "kx"), "yy": ("ky", "ky"), "zz": ("kz", "kz"), "xy": ("kx", "ky"), "xz": ("kx", "kz"), "yz": ("ky", "kz")}
    sums = [F.count_if(band).alias("_n")]
    for tag, test in (("b", band), ("u", upper)):
        sums.append(F.sum(F.when(test, power)).alias(f"_{tag}"))
        sums += [F.sum(F.when(test, power * F.col(i) * F.col(j) / r2)).alias(f"_{tag}{n}") for n, (i, j) in pairs.items()]
    agg = placed.groupBy(*keys).agg(*sums)
    sparse = F.col("_n") < F.lit(fallback or 0)

    def pick(n: str) -> Column:
        return F.when(sparse, F.col(f"_u{n}")).otherwise(F.col(f"_b{n}"))

    picked = agg.select(*keys, pick("").alias("_t"), *[F.try_divide(pick(n), pick("")).alias(n) for n in pairs])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 3 * F.col("_min")))
    return add_least_eigenvalue(picked, "_min").select(
        *keys, F.when(F.col("_t") > 0, score).otherwise(F.lit(1.0)).alias("isotropy_score")
    )


def equalise_amplitudes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Give every map the mean amplitude over maps, coefficient by coefficient; phases stay."""
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    mean = df.groupBy(*keys, *K).agg(F.avg(amp).alias("_mean"))
    factor = F.coalesce(F.try_divide(F.col("_mean"), amp), F.lit(0.0))
    return df.join(mean, [*keys, *K]).withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor}).drop("_mean")


def scatter_add(images: DataFrame, particles: DataFrame, keys: Sequence[str], size: int, image: str = "image") -> DataFrame:
    """Sum rotated image coefficients on a 3-D grid and divide by how many fell on each place.

    ``images`` holds planar coefficients per image, ``particles`` the three angles. Points
    with a negative first axis are mirrored with the conjugate value. Sums are combined on
    every executor before they move.
    """
    m = matrix_from_zyz(F.col("rot"), F.col("tilt"), F.col("psi"))
    both = images.join(particles.select(image, *keys, "rot", "tilt", "psi"), image).filter("re != 0 or im != 0")
    kx, ky = F.col("kx"), F.col("ky")
    x, y, z = (m[3 * i] * kx + m[3 * i + 1] * ky for i in range(3))
    flip = F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    turned = both.select(*keys, "re", (F.col("im") * flip).alias("im"), *[F.rint(c * flip).cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])
    half = size // 2
    kept = turned.filter((F.abs("x") <= half) & (F.abs("y") <= half) & (F.abs("z") <= half))
    grid = kept.groupBy(*keys, *[F.pmod(F.col(a), F.lit(size)).alias(f"i{a}") for a in "zyx"]).agg(
        F.sum("re").alias("_re"), F.sum("im").alias("_im"), F.count(F.lit(1)).alias("weight")
    )
    return grid.withColumns({"re": F.col("_re") / (F.col("weight") + 1e-8), "im": F.col("_im") / (F.col("weight") + 1e-8)}).drop("_re", "_im")


def _frequency(size: int, pixel: float) -> Column:
    return F.sqrt(radius2()) / F.lit(size * pixel)


def sharpen(df: DataFrame, bfactor: float, size: int, pixel: float) -> DataFrame:
    """Weight by exp(-B s^2 / 4)."""
    w = F.exp(F.lit(-bfactor / 4) * radius2() / F.lit((size * pixel) ** 2))
    return df.withColumns({"re": F.col("re") * w, "im": F.col("im") * w})


def low_pass(df: DataFrame, cutoff: float, size: int, pixel: float, edge: int = 2) -> DataFrame:
    """Raised-cosine low-pass at a resolution; nothing to do at or beyond Nyquist."""
    if cutoff <= 0 or 1 / cutoff >= 0.5 / pixel:
        return df
    s, centre, delta = _frequency(size, pixel), 1 / cutoff, edge / (pixel * size)
    ramp = 0.5 * (1 + F.cos(F.lit(math.pi) * (s - (centre - delta)) / (2 * delta)))
    w = F.when(s > centre + delta, F.lit(0.0)).when(s >= centre - delta, ramp).otherwise(F.lit(1.0))
    return df.withColumns({"re": F.col("re") * w, "im": F.col("im") * w})


def weight_by_curve(df: DataFrame, curve: DataFrame, keys: Sequence[str], size: int, pixel: float) -> DataFrame:
    """Weight by sqrt(2F / (1+F)) with F interpolated from a shell curve.

    Everything beyond the last shell before the curve first falls below 1e-4 becomes 0.
    ``curve`` has ``shell``, ``frequency`` and ``fsc`` with evenly spaced frequencies; it
    has one row per shell, so collecting it per map makes a short array.
    """
    first_low = F.min(F.when(F.col("fsc") < 1e-4, F.col("shell")))
    arrays = curve.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("shell", "frequency", "fsc"))).alias("_c"), first_low.alias("_low"), F.count(F.lit(1)).alias("_m")
    )
    joined = df.join(arrays, list(keys))
    at = lambda i, field: F.element_at("_c", (i + 1).cast("int"))[field]
    last = F.greatest(F.coalesce(F.col("_low"), F.col("_m")) - 1, F.lit(0))
    s = _frequency(size, pixel)
    f0 = at(F.lit(0), "frequency")
    step = at(F.lit(1), "frequency") - f0
    place = F.least(F.greatest((s - f0) / step, F.lit(0.0)), (F.col("_m") - 1).cast("double"))
    low = F.least(F.floor(place), F.col("_m") - 2)
    value = at(low, "fsc") + (place - low) * (at(low + 1, "fsc") - at(low, "fsc"))
    w = F.when((s <= at(last, "frequency")) & (value > 0), F.sqrt(2 * value / (1 + value))).otherwise(F.lit(0.0))
    return joined.withColumns({"re": F.col("re") * w, "im": F.col("im") * w}).drop("_c", "_low", "_m")


def swap_amplitudes(phases: DataFrame, amplitudes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Phases of one table with the amplitudes of another; zero where there is no phase."""
    other = amplitudes.select(*keys, *K, F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_b"))
    own = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    factor = F.coalesce(F.try_divide(F.col("_b"), own), F.lit(0.0))
    return phases.join(other, [*keys, *K]).withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor}).drop("_b")


def half_map_quality(first: DataFrame, second: DataFrame, keys: Sequence[str], size: int, pixel: float, bins: int, threshold: float = 0.143) -> DataFrame:
    """Resolution and three scores of a pair of half maps with their geometric mean."""
    from motes.operators.history import threshold_crossing

    keys = list(keys)
    curve = shell_correlation(first, second, keys, bins, size, pixel).filter("fsc is not null and frequency > 0")
    curve = checkpointed(curve)  # a few rows per pair, read four times below
    nyquist = 0.5 / pixel
    cross = threshold_crossing(curve, keys, "frequency", "fsc", threshold, "shell").select(*keys, F.col("frequency").alias("_f"))
    above = curve.groupBy(*keys).agg(
        F.max(F.when(F.col("fsc") > threshold, F.col("frequency"))).alias("_above"), F.max("frequency").alias("_last")
    )
    cut = above.join(cross, keys, "left").select(*keys, F.coalesce("_f", "_above", "_last").alias("_res"))
    cut = checkpointed(cut.withColumn("_cut", F.least("_res", F.lit(nyquist))))
    f2 = F.col("frequency") * F.col("frequency")
    inside = F.col("frequency") <= F.col("_cut")
    score = curve.join(cut, keys).groupBy(*keys, "_res", "_cut").agg(
        F.try_divide(F.sum(F.when(inside, F.col("fsc") * f2)), F.sum(F.when(inside, f2))).alias("fsc_score")
    )
    mean = first.join(second.select(*keys, *K, F.col("re").alias("_r"), F.col("im").alias("_i")), [*keys, *K]).select(
        *keys, *K, ((F.col("re") + F.col("_r")) / 2).alias("re"), ((F.col("im") + F.col("_i")) / 2).alias("im")
    )
    tagged = mean.join(cut, keys)
    band = [*keys, "_res", "_cut"]
    res = 1 / F.col("_res")
    amp = amplitude_falloff(tagged, band, size, pixel, F.greatest(res * 2, res + 2, F.lit(8.0)), res)
    iso = direction_isotropy(tagged, band, 0.7 * F.col("_cut"), F.col("_cut"), size, pixel)
    joined = score.join(amp.drop("_res", "_cut"), keys).join(iso.drop("_res", "_cut"), keys)
    clip = lambda c: F.greatest(F.lit(1e-8), F.least(F.lit(1.0), F.col(c)))
    return joined.select(
        *keys,
        (1 / F.col("_res")).alias("resolution"),
        "fsc_score",
        "amplitude_score",
        "isotropy_score",
        F.pow(clip("fsc_score") * clip("amplitude_score") * clip("isotropy_score"), F.lit(1 / 3)).alias("score"),
    )
