"""Coordinates, tilt geometry and projections of picks in tomograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NM = 10.0
MICROMETRE = 10_000.0


# --- coordinates -----------------------------------------------------------


def voxel_to_angstrom(v: Sequence[Column], size: Sequence[Column], pixel: Column, binning: Column, one_based: bool = False) -> list[Column]:
    """Voxel coordinates to Angstrom about the centre of the unbinned volume."""
    return [((c - (1.0 if one_based else 0.0)) * binning - n / 2) * pixel for c, n in zip(v, size)]


def angstrom_to_voxel(a: Sequence[Column], size: Sequence[Column], pixel: Column, binning: Column, one_based: bool = False) -> list[Column]:
    return [(c / pixel + n / 2) / binning + (1.0 if one_based else 0.0) for c, n in zip(a, size)]


def roundtrip_error(v: Sequence[Column], size: Sequence[Column], pixel: Column, binning: Column, one_based: bool = False) -> Column:
    """Largest coordinate change of going to Angstrom and back."""
    back = angstrom_to_voxel(voxel_to_angstrom(v, size, pixel, binning, one_based), size, pixel, binning, one_based)
    return F.greatest(*[F.abs(b - c) for b, c in zip(back, v)])


def reorder_axes(values: Sequence[Column], order: str) -> tuple[Column, Column, Column]:
    """Three values given in ``order`` (a permutation of xyz) as x, y, z."""
    if sorted(order.lower()) != ["x", "y", "z"]:
        raise ValueError(f"{order} is not a permutation of xyz")
    place = {axis: values[i] for i, axis in enumerate(order.lower())}
    return place["x"], place["y"], place["z"]


def flip_axis(v: Column, size: Column, one_based: bool = False) -> Column:
    return (size + 1 if one_based else size - 1) - v


def roi_radius(radius: Column, diameter: Column, radius_voxel: Column, pixel: Column) -> Column:
    """Radius in Angstrom from the first positive of radius, diameter and voxel radius."""
    return F.coalesce(F.when(radius > 0, radius), F.when(diameter > 0, diameter / 2), F.when(radius_voxel > 0, radius_voxel * pixel))


def storage_box(radius: Column, padding: Column | float = 0.0) -> Column:
    """Smallest even side, at least 2, that holds a sphere and its padding."""
    side = F.ceil(2.0 * (radius + padding)).cast("int")
    return F.greatest(side + side % 2, F.lit(2))


def circle_inside(x: Column, y: Column, radius: Column, nx: Column, ny: Column) -> Column:
    return (x - radius >= 0) & (y - radius >= 0) & (x + radius <= nx) & (y + radius <= ny)


def sphere_inside(v: Sequence[Column], radius: Column, size: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c, n in zip(v, size):
        out = out & (c - radius >= 0) & (c + radius <= n)
    return out


def tomogram_size(dim: Column, binning: Column, aligned: Column) -> Column:
    """Unbinned size: scaled volume size, else the aligned stack's, else 0."""
    return F.coalesce(F.rint(dim * binning).cast("int"), aligned, F.lit(0))


def apply_affine(x: Column, y: Column, a: Sequence[Column]) -> tuple[Column, Column]:
    a11, a12, a21, a22, dx, dy = a
    return a11 * x + a12 * y + dx, a21 * x + a22 * y + dy


def invert_affine(x: Column, y: Column, a: Sequence[Column]) -> tuple[Column, Column]:
    """Point before the affine was applied."""
    a11, a12, a21, a22, dx, dy = a
    det = a11 * a22 - a12 * a21
    u, v = x - dx, y - dy
    return (a22 * u - a12 * v) / det, (a11 * v - a21 * u) / det


# --- defocus ---------------------------------------------------------------


def defocus_to_angstrom(value: Column, unit: Column) -> Column:
    """Defocus in Angstrom; an unknown unit is an error."""
    u = F.lower(unit)
    return (
        F.when(u.isin("a", "angstrom", "angstroms", "ang"), value)
        .when(u.isin("nm", "nanometer", "nanometre", "nanometers"), value * NM)
        .when(u.isin("um", "µm", "micrometer", "micrometre", "micron", "microns"), value * MICROMETRE)
        .otherwise(F.raise_error(F.concat(F.lit("unknown defocus unit "), F.coalesce(unit, F.lit("NULL")))).cast("double"))
    )


def guess_defocus_unit(df: DataFrame, keys: Sequence[str], value: str = "defocus", **cutting) -> DataFrame:
    """Unit guessed from the upper median magnitude of each group; nm when there is none."""
    from motes.operators.ordered import order_statistics

    sized = df.withColumn("_abs", F.abs(value))
    mid = order_statistics(sized, keys, "_abs", {"_mid": F.floor(F.col("_n") / 2)}, **cutting)
    m = F.col("_mid")
    unit = F.when(m < 100, "micrometer").when(m < 9000, "nm").otherwise("angstrom")
    return df.select(*keys).distinct().join(mid, list(keys), "left").select(*keys, F.when(m.isNull(), F.lit("nm")).otherwise(unit).alias("unit"))


# --- tilts -----------------------------------------------------------------


def excluded_tilts(df: DataFrame, keys: Sequence[str], listing: str, count: str) -> DataFrame:
    """Tilt numbers named by lists such as ``1,2,5-7``; a number out of range is an error."""
    part = df.select(*keys, count, F.explode(F.split(F.split(F.trim(listing), r"\s+")[0], ",")).alias("_p")).filter(F.trim("_p") != "")
    ends = F.split("_p", "-", 2)
    a = F.trim(ends[0]).cast("int")
    b = F.coalesce(F.trim(F.try_element_at(ends, F.lit(2))).cast("int"), a)
    good = (a >= 1) & (b >= 1) & (a <= F.col(count)) & (b <= F.col(count))
    checked = F.when(good, F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(
        F.raise_error(F.concat(F.lit("bad exclusion "), F.col("_p"))).cast("array<int>")
    )
    return part.select(*keys, F.explode(checked).alias("tilt_index")).distinct()


Matrix = list[list["Column | float"]]


def _times(a: Matrix, b: Matrix) -> Matrix:
    """Product of two 4 x 4 matrices; constant zeros and ones leave no trace in the plan."""

    def term(x, y):
        if isinstance(x, float) and isinstance(y, float):
            return x * y
        if isinstance(x, float):
            x, y = y, x
        if isinstance(y, float):
            return 0.0 if y == 0.0 else x if y == 1.0 else x * F.lit(y)
        return x * y

    def total(parts):
        constant = sum(p for p in parts if isinstance(p, float))
        columns = [p for p in parts if not isinstance(p, float)]
        if not columns:
            return constant
        out = columns[0]
        for c in columns[1:]:
            out = out + c
        return out + F.lit(constant) if constant else out

    return [[total([term(a[i][k], b[k][j]) for k in range(4)]) for j in range(4)] for i in range(4)]


def _unit() -> Matrix:
    return [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]


def _shift(x, y, z) -> Matrix:
    m = _unit()
    m[0][3], m[1][3], m[2][3] = x, y, z
    return m


def tilt_matrices(
    tilts: DataFrame,
    keys: Sequence[str],
    thickness: str = "thickness",
    flip: str = "none",
    flip_angles: bool = False,
    for_aligned: bool = False,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """World-to-image matrix of every kept tilt as sixteen columns ``m00 .. m33``.

    ``tilts`` has one row per tilt: ``tilt_index``, ``tilt_angle``, the affine
    (``a11 .. dy``), image centres ``ox, oy`` (raw) and ``cx, cy`` (aligned), ``binning``,
    ``thickness``, ``shift_x, shift_y`` and ``off_x, off_y, off_z``. ``flip`` is ``none``,
    ``yz`` or ``yz_z``. Kept tilts are renumbered from 1 in ``frame``.
    """
    keys = list(keys)
    if excluded is not None:
        tilts = tilts.join(excluded, [*keys, "tilt_index"], "left_anti")
    c = F.col
    angle = F.radians(-c("tilt_angle") if flip_angles else c("tilt_angle"))
    ca, sa = F.cos(angle), F.sin(angle)
    turn: Matrix = [[ca, -sa, 0.0, c("cx")], [0.0, 0.0, 1.0, c("cy")], [-sa, -ca, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    turn = _times(turn, _shift(-c("cx"), 0.0, -c("cy")))

    inner = _unit()
    if not for_aligned:
        det = c("a11") * c("a22") - c("a12") * c("a21")
        i11, i12, i21, i22 = c("a22") / det, -c("a12") / det, -c("a21") / det, c("a11") / det
        inner = [
            [i11, i12, 0.0, -(i11 * c("dx") + i12 * c("dy"))],
            [i21, i22, 0.0, -(i21 * c("dx") + i22 * c("dy"))],
            [0.0, 0.0, 1.0, 0.0],
            [0.0, 0.0, 0.0, 1.0],
        ]
    affine = _times(_times(_shift(c("ox"), c("oy"), 0.0), inner), _shift(-c("cx"), -c("cy"), 0.0))
    for i in range(3):
        for j in range(3):
            entry = affine[i][j]
            affine[i][j] = (c("binning") * F.lit(entry) if entry else 0.0) if isinstance(entry, float) else entry * c("binning")

    origin = _shift(-1.0, c(thickness) / -2.0, -1.0)
    offset = _shift(c("off_x") - c("shift_x"), c("off_y") - c("shift_y"), c("off_z"))
    flips: dict[str, Matrix] = {
        "none": _unit(),
        "yz": [[1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]],
        "yz_z": [[1.0, 0.0, 0.0, 0.0], [0.0, 0.0, -1.0, c(thickness) - 1], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]],
    }
    world = _times(_times(_times(_times(affine, turn), origin), offset), flips[flip])
    entries = {f"m{i}{j}": F.lit(world[i][j]) if isinstance(world[i][j], float) else world[i][j] for i in range(4) for j in range(4)}
    w = Window.partitionBy(*keys).orderBy("tilt_index")  # a series has at most a few hundred tilts
    return tilts.select(
        *keys, "tilt_index", F.row_number().over(w).alias("frame"), "tilt_angle", "a11", "a12", "a21", "a22", "dx", "dy",
        *[v.cast("double").alias(n) for n, v in entries.items()],
    )


def project_picks(picks: DataFrame, matrices: DataFrame, keys: Sequence[str], binning: str = "pick_binning", radius: str = "radius", nx: str = "nx", ny: str = "ny") -> DataFrame:
    """Every pick in every tilt of its tomogram: centres in aligned and raw images, whether
    the centre is visible and whether the circle lies inside each frame.

    ``picks`` has ``particle, x, y, z`` and the named columns; the depth axis of a volume is
    the second world axis.
    """
    b = F.col(binning)
    world = [F.col("x") * b, F.col("z") * b, F.col("y") * b]
    both = picks.join(matrices, list(keys))

    def row(i: int) -> Column:
        return sum((F.col(f"m{i}{j}") * world[j] for j in range(1, 3)), F.col(f"m{i}0") * world[0]) + F.col(f"m{i}3")

    placed = both.withColumn("ali_x", row(0)).withColumn("ali_y", row(1))
    affine = [F.col(n) for n in ("a11", "a12", "a21", "a22", "dx", "dy")]
    raw_x, raw_y = invert_affine(F.col("ali_x"), F.col("ali_y"), affine)
    placed = placed.withColumn("raw_x", raw_x).withColumn("raw_y", raw_y)
    r, w, h = F.col(radius), F.col(nx), F.col(ny)
    return placed.select(
        *keys, "particle", "tilt_index", "tilt_angle", "ali_x", "ali_y", "raw_x", "raw_y",
        ((F.col("ali_x") >= 0) & (F.col("ali_x") <= w) & (F.col("ali_y") >= 0) & (F.col("ali_y") <= h)).alias("visible"),
        circle_inside(F.col("ali_x"), F.col("ali_y"), r, w, h).alias("ali_inside"),
        circle_inside(F.col("raw_x"), F.col("raw_y"), r, w, h).alias("raw_inside"),
    )
