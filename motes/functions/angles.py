"""Viewing angles and rotations as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from motes.functions.fixed import ROT_LIMIT, TILT_LIMIT, VIEW_DEGREE


def wrapped(angle: Column, period: float = 360.0) -> Column:
    """The angle in ``[0, period)``."""
    return F.pmod(angle, F.lit(float(period)))


def direction(rot: Column, tilt: Column, compat: bool = True) -> tuple[Column, Column, Column]:
    """Direction point of a view.

    With ``compat`` the third component is the sine of the tilt, as in existing rankings,
    so tilts t and 180-t coincide; without it, the cosine.
    """
    r, t = rot * F.lit(VIEW_DEGREE), tilt * F.lit(VIEW_DEGREE)
    return F.sin(t) * F.cos(r), F.sin(t) * F.sin(r), F.sin(t) if compat else F.cos(t)


def direction_distance2(rot1: Column, tilt1: Column, rot2: Column, tilt2: Column, compat: bool = True) -> Column:
    """Squared distance between two directions."""
    a, b = direction(rot1, tilt1, compat), direction(rot2, tilt2, compat)
    return sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))


def angle_bins(rot: Column, tilt: Column, bins: int) -> tuple[Column, Column]:
    """Bin numbers of both angles wrapped to [-pi, pi) and [-pi/2, pi/2).

    A value outside the fixed histogram limits has no bin (NULL).
    """

    def one(angle: Column, period: float, limit: float) -> Column:
        value = F.pmod(angle * F.lit(math.pi) / F.lit(180.0), F.lit(period)) - F.lit(period / 2)
        inside = (value >= -limit) & (value <= limit)
        width = 2 * limit / bins
        return F.when(inside, F.least(F.floor((value + F.lit(limit)) / F.lit(width)).cast("bigint"), F.lit(bins - 1)))

    return one(rot, 2 * math.pi, ROT_LIMIT), one(tilt, math.pi, TILT_LIMIT)


def rotation_from_vector(v: Column) -> list[Column]:
    """Nine row-major entries of the rotation about ``v`` by its length."""
    x, y, z = (v[i].cast("double") for i in range(3))
    angle = F.sqrt(x * x + y * y + z * z)
    tiny = angle < 1e-8
    safe = F.when(tiny, F.lit(1.0)).otherwise(angle)
    x, y, z = x / safe, y / safe, z / safe
    s, c = F.sin(angle), 1 - F.cos(angle)
    full = [
        1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y,
        c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y),
    ]
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    return [F.when(tiny, F.lit(u)).otherwise(f) for u, f in zip(unit, full)]


def rotation_from_quaternion(q: Column) -> list[Column]:
    """Nine row-major entries from a quaternion ordered w, x, y, z, of any length."""
    w, x, y, z = (q[i].cast("double") for i in range(4))
    n = w * w + x * x + y * y + z * z
    k = F.lit(2.0) / n
    return [
        1 - k * (y * y + z * z), k * (x * y - w * z), k * (x * z + w * y),
        k * (x * y + w * z), 1 - k * (x * x + z * z), k * (y * z - w * x),
        k * (x * z - w * y), k * (y * z + w * x), 1 - k * (x * x + y * y),
    ]


def zyz_degrees(matrix: list[Column]) -> tuple[Column, Column, Column]:
    """Rot, tilt and psi of a rotation matrix given as nine columns."""
    tilt = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), matrix[8]))))
    rot = F.degrees(F.atan2(matrix[5], matrix[2]))
    # not -matrix[6]: a negative zero would turn the identity by 180 degrees
    psi = F.degrees(F.atan2(matrix[7], F.lit(0.0) - matrix[6]))
    return rot, tilt, psi


def pose_angles(pose: Column, length: int) -> tuple[Column, Column, Column]:
    """Angles of a pose stored as a rotation vector (3), quaternion (4) or matrix (9)."""
    if length == 3:
        return zyz_degrees(rotation_from_vector(pose))
    if length == 4:
        return zyz_degrees(rotation_from_quaternion(pose))
    if length == 9:
        return zyz_degrees([pose[i].cast("double") for i in range(9)])
    raise ValueError(f"a pose has 3, 4 or 9 numbers, not {length}")


def matrix_from_zyz(rot: Column, tilt: Column, psi: Column) -> list[Column]:
    """Nine row-major entries of R = Z(rot) Y(tilt) Z(psi)."""
    a, b, g = F.radians(rot), F.radians(tilt), F.radians(psi)
    ca, sa, cb, sb, cg, sg = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(g), F.sin(g)
    return [
        ca * cb * cg - sa * sg, -ca * cb * sg - sa * cg, ca * sb,
        sa * cb * cg + ca * sg, -sa * cb * sg + ca * cg, sa * sb,
        -sb * cg, sb * sg, cb,
    ]
