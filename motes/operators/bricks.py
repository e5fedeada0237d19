"""Volumes as tables of bricks, and boxes cut from them.

A volume is a table of bricks: a cube of ``side`` voxels, its key, and the places and values of the voxels in
it. A box no wider than a brick touches at most eight of them, so a pick meets eight rows whatever
its box holds; the parts are cut in Arrow batches and come together as one row per box.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from motes.operators.ordered import join_on_keys

AXES = ("z", "y", "x")
SIDE = 16
# Values of the boxes in one Arrow batch.
BATCH_VALUES = 1 << 21


def _brick(place: Column, side: int) -> Column:
    return F.floor(place / F.lit(side)).cast("int")


def brick_table(volumes: DataFrame, keys: Sequence[str], side: int = SIDE, value: str = "v") -> DataFrame:
    """One row per brick: ``keys``, ``bz``, ``by``, ``bx`` and ``cells``, places inside the brick (``o``, z first) with values.

    Voxels without a value are left out. A group is one brick, so it has at most ``side`` cubed voxels.
    """
    inside = None
    for a in AXES:
        step = F.col(a) - _brick(F.col(a), side) * side
        inside = step if inside is None else inside * side + step
    cell = F.struct(inside.cast("int").alias("o"), F.col(value).cast("double").alias("v"))
    named = [_brick(F.col(a), side).alias(f"b{a}") for a in AXES]
    return volumes.filter(F.col(value).isNotNull()).groupBy(*keys, *named).agg(F.collect_list(cell).alias("cells"))


def _parts(side: int, box: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each brick has of a box: places in the box and values."""
        for batch in batches:
            low = [batch.column(f"{a}0").to_numpy(zero_copy_only=False) for a in AXES]
            corner = [batch.column(f"b{a}").to_numpy(zero_copy_only=False) for a in AXES]
            cells = batch.column("cells")
            ends = cells.offsets.to_numpy()
            places, values = cells.values.field("o").to_numpy(), cells.values.field("v").to_numpy()
            at, found, sizes = [], [], [0]
            for i in range(batch.num_rows):
                if cells[i].is_valid:
                    o, v = places[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]]
                    steps = (o // (side * side), o // side % side, o % side)
                    z, y, x = (c[i] * side + s - p[i] for c, s, p in zip(corner, steps, low, strict=True))
                    hit = (z >= 0) & (z < box) & (y >= 0) & (y < box) & (x >= 0) & (x < box)
                    at.append(((z * box + y) * box + x)[hit].astype(np.int32))
                    found.append(v[hit])
                sizes.append(sizes[-1] + (len(at[-1]) if cells[i].is_valid else 0))
            offsets = pa.array(sizes, pa.int32())
            at = np.concatenate(at) if at else np.zeros(0, np.int32)
            found = np.concatenate(found) if found else np.zeros(0)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (at, found)]
            yield pa.RecordBatch.from_arrays([batch.column("pick"), *lists], names=["pick", "at", "vs"])

    return cut


def _whole(box: int, radius: float | None, pad_value: float):
    centre = (box - 1) / 2.0
    d2 = sum((g - centre) ** 2 for g in np.meshgrid(*[np.arange(box)] * 3, indexing="ij")).ravel()
    outside = np.zeros(box**3, bool) if radius is None else d2 > radius * radius
    step = max(1, BATCH_VALUES // box**3)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                out = np.full((some.num_rows, box**3), pad_value, np.float64)
                for i, parts in enumerate(some.column("parts")):
                    for part in parts.values:
                        out[i, part["at"].values.to_numpy()] = part["vs"].values.to_numpy()
                out[:, outside] = pad_value
                ends = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * box**3)
                yield pa.RecordBatch.from_arrays([some.column("pick"), some.column("copies"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["pick", "copies", "px"])

    return assemble


def cut_packed_boxes(
    picks: DataFrame,
    volumes: DataFrame,
    sizes: DataFrame,
    box: int,
    radius: float | None = None,
    policy: str = "pad",
    pad_value: float = 0.0,
    keys: Sequence[str] = ("tomo",),
    side: int | None = None,
) -> DataFrame:
    """A cube around each pick (``particle``, ``cz``, ``cy``, ``cx``) as one row: ``keys``, ``particle``, ``px`` (z first).

    Places without a voxel get ``pad_value``. Picks whose sphere leaves the volume (``sizes`` has ``nz``, ``ny``, ``nx``) are
    dropped by ``skip`` and an error with ``error``; ``radius`` also masks outside the sphere. Picks of a volume that
    ``sizes`` lacks give no box. ``side`` is that of the bricks, by default as wide as the box and at least 16.
    """
    keys = list(keys)
    side = side or max(SIDE, box)
    if side < box:
        raise ValueError(f"a box of {box} may touch more than eight bricks of {side}")
    half = box // 2
    r = radius or 0.0
    placed = picks.join(sizes, keys)
    inside = None
    for a in AXES:
        test = (F.col(f"c{a}") - r >= 0) & (F.col(f"c{a}") + r <= F.col(f"n{a}"))
        inside = test if inside is None else inside & test
    if policy == "skip":
        placed = placed.filter(inside)
    elif policy == "error":
        placed = placed.filter(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("a pick reaches outside its volume")).cast("boolean")))
    elif policy != "pad":
        raise ValueError(f"unknown policy {policy}")

    # equal picks are one box, written as often as they come
    corner = [(F.rint(f"c{a}").cast("int") - half).alias(f"{a}0") for a in AXES]
    distinct = placed.groupBy(*keys, "particle", *corner).agg(F.count(F.lit(1)).alias("copies"))
    met = distinct
    for a in AXES:
        first, last = _brick(F.col(f"{a}0"), side), _brick(F.col(f"{a}0") + (box - 1), side)
        met = met.withColumn(f"b{a}", F.explode_outer(F.when(F.col(f"{a}0").isNotNull(), F.array_distinct(F.array(first, last)))))
    met = met.select(F.struct(*keys, "particle", *[f"{a}0" for a in AXES], "copies").alias("pick"), *keys, *[f"{a}0" for a in AXES], *[f"b{a}" for a in AXES])
    joined = join_on_keys(met, brick_table(volumes, keys, side), [*keys, *[f"b{a}" for a in AXES]], "left")
    one = joined.select("pick", *[F.coalesce(f"{a}0", F.lit(0)).alias(f"{a}0") for a in AXES], *[F.coalesce(f"b{a}", F.lit(0)).alias(f"b{a}") for a in AXES], "cells")
    pick = StructField("pick", one.schema["pick"].dataType)
    parts = one.mapInArrow(_parts(side, box), StructType([pick, *StructType.fromDDL("at array<int>, vs array<double>").fields]))
    # at most eight parts a box
    gathered = parts.groupBy("pick").agg(F.collect_list(F.struct("at", "vs")).alias("parts")).select("pick", F.col("pick.copies").alias("copies"), "parts")
    fields = [StructField("pick", pick.dataType), *StructType.fromDDL("copies bigint").fields, StructField("px", ArrayType(DoubleType()))]
    boxes = gathered.mapInArrow(_whole(box, radius, pad_value), StructType(fields))
    every = boxes.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return every.select(*[F.col("pick")[k].alias(k) for k in [*keys, "particle"]], "px")
