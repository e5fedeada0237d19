"""Even viewing directions and the nearest one to each particle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.functions.angles import direction, wrapped
from motes.functions.fixed import VIEW_DEGREE

# Side of a lookup cell in degrees; 32,400 cells cover both full circles.
CELL = 2
# Pairs of square and view that are compared at a time while the table is built.
VIEWS_AT_ONCE = 500_000


def even_views(count: int) -> list[tuple[float, float]]:
    """(rot, tilt) in degrees on a golden spiral.

    The height grows by repeated addition, so rounding can push the last view past the
    pole; it is then left out (200 asked for gives 199).
    """
    golden = (3 - math.sqrt(5.0)) * math.pi
    step = 2.0 / (count - 1.0)
    heights = np.add.accumulate(np.concatenate(([-1.0], np.full(count - 1, step))))
    return [
        (math.fmod(math.fmod(i * golden, 2 * math.pi) + 2 * math.pi, 2 * math.pi) * 180.0 / math.pi, math.acos(h) * 180.0 / math.pi)
        for i, h in enumerate(heights.tolist())
        if h <= 1.0
    ]


def _points(rot: np.ndarray, tilt: np.ndarray, compat: bool) -> np.ndarray:
    r, t = rot * VIEW_DEGREE, tilt * VIEW_DEGREE
    return np.stack([np.sin(t) * np.cos(r), np.sin(t) * np.sin(r), np.sin(t) if compat else np.cos(t)], axis=-1)


def _refined(at: np.ndarray, compat: bool, side: int, width: int, square: np.ndarray, owner: np.ndarray, view: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and the views that may win in them, from squares of ``width`` cells with the views that may win in those.

    A quad-tree: each square keeps the views that a bound leaves, and its quarters look only at
    these. Squares with many views between them are refined one after the other, so little is held at a time.
    """
    if len(view) > VIEWS_AT_ONCE and len(square) > 1:
        half = len(square) // 2
        cut = np.searchsorted(owner, half)
        yield from _refined(at, compat, side, width, square[:half], owner[:cut], view[:cut])
        yield from _refined(at, compat, side, width, square[half:], owner[cut:] - half, view[cut:])
        return
    middle = (square + 0.5) * width * CELL
    centre = _points(middle[:, 0], middle[:, 1], compat)
    gap = np.sqrt(((centre[owner] - at[view]) ** 2).sum(-1))
    begins = np.searchsorted(owner, np.arange(len(square)))
    reach = math.radians(width * CELL / 2) * (1 + math.sqrt(2)) * (1 + 1e-6)
    kept = gap <= np.minimum.reduceat(gap, begins)[owner] + 2 * reach
    owner, view = owner[kept], view[kept]
    if width == 1:
        yield (square[:, 0] * side + square[:, 1])[owner], view
        return
    quarters = (square[:, None, :] * 2 + np.array([(0, 0), (0, 1), (1, 0), (1, 1)])).reshape(-1, 2)
    inside = (quarters * (width // 2) < side).all(1)
    sizes = np.bincount(owner, minlength=len(square))
    begins = np.cumsum(sizes) - sizes
    parents = np.repeat(np.arange(len(square)), 4)[inside]
    # every quarter inherits the views of its square
    for some in np.array_split(np.arange(len(parents)), max(1, int(sizes[parents].sum()) // VIEWS_AT_ONCE)):
        lengths = sizes[parents[some]]
        offsets = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inherited = view[np.repeat(begins[parents[some]], lengths) + offsets]
        yield from _refined(at, compat, side, width // 2, quarters[inside][some], np.repeat(np.arange(len(some)), lengths), inherited)


@lru_cache(maxsize=16)
def _candidates(count: int, compat: bool) -> pa.Table:
    """Per lookup cell, every view that can be the nearest for some angle in the cell.

    A direction moves at most sqrt(2) per radian of tilt and 1 per radian of rot, which
    bounds how far a cell reaches from its centre; by the triangle inequality a view
    farther than the best one by twice that reach cannot win.
    """
    views = np.array(even_views(count))
    at = _points(views[:, 0], views[:, 1], compat)
    side = 360 // CELL
    width = 1 << (side - 1).bit_length()
    found = list(_refined(at, compat, side, width, np.zeros((1, 2), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))))
    cell, view = (np.concatenate([f[i] for f in found]) for i in range(2))
    order = np.lexsort((view, cell))
    view = view[order]
    per_cell = np.bincount(cell, minlength=side * side)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(per_cell))), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(view, pa.int32()), *(pa.array(at[view, axis]) for axis in range(3))], ["view", "x", "y", "z"]
        ),
    )
    index = np.arange(side * side)
    return pa.table({"_rc": pa.array(index // side, pa.int32()), "_tc": pa.array(index % side, pa.int32()), "_views": lists})


@lru_cache(maxsize=16)
def _lookup(spark: SparkSession, count: int, compat: bool) -> DataFrame:
    return spark.createDataFrame(_candidates(count, compat))


def nearest_view(
    particles: DataFrame,
    count: int,
    rot: str = "rot",
    tilt: str = "tilt",
    out: str = "view",
    compat: bool = True,
) -> DataFrame:
    """Nearest even view of each particle, lowest number on ties; NULL where an angle is.

    Looks up the few views that can win in the particle's angle cell; the lookup table has
    a fixed size, so broadcasting it is safe at any number of particles.
    """
    side = 360 // CELL
    x, y, z = direction(F.col(rot), F.col(tilt), compat)

    def cell(angle: str):
        at = F.floor(wrapped(F.col(angle)) / CELL)
        # least() would skip a NULL angle, which has no view
        return F.when(at.isNotNull(), F.least(at, F.lit(side - 1))).cast("int")

    placed = particles.withColumns({"_rc": cell(rot), "_tc": cell(tilt), "_x": x, "_y": y, "_z": z})
    joined = placed.join(F.broadcast(_lookup(particles.sparkSession, count, compat)), ["_rc", "_tc"], "left")

    def scored(v):
        dx, dy, dz = F.col("_x") - v["x"], F.col("_y") - v["y"], F.col("_z") - v["z"]
        return F.struct((dx * dx + dy * dy + dz * dz).alias("d"), v["view"].alias("view"))

    only = F.when(F.size("_views") == 1, F.col("_views")[0]["view"])
    best = only.otherwise(F.array_min(F.transform("_views", scored))["view"])
    return joined.withColumn(out, best).drop("_rc", "_tc", "_x", "_y", "_z", "_views")
