"""Binary image stacks and structured arrays, read in slices on the executors.

A header pass makes one row per file; data is then read in ranges of bounded size, so a
stack of any size is shared by many tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.functions.fixed import STACK_MODES
from motes.sources.lines import list_files

HEADER_BYTES = 1024
RANGE_BYTES = 32 << 20


def _open(path: str):
    """A seekable reader for any file system that Arrow knows."""
    from pyarrow import fs

    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    system, place = fs.FileSystem.from_uri(uri)
    return system.open_input_file(place)


def _spread(files: DataFrame) -> DataFrame:
    """Ranges of very different files go to all tasks evenly."""
    return files.repartition(F.col("path"), F.col("first"))


HEADER_SCHEMA = (
    "path string, nx int, ny int, nz int, mode int, data_offset bigint, pixel_x double, pixel_y double, pixel_z double"
)


def stack_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header catalogue: sizes, pixel type, where the data starts, and pixel sizes."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name in part["path"]:
                with _open(name) as f:
                    head = f.read(HEADER_BYTES)
                if len(head) < HEADER_BYTES:
                    raise ValueError(f"{name} is too short for a header")
                whole, real = np.frombuffer(head, "<i4"), np.frombuffer(head, "<f4")
                n = whole[0:3].astype(int)
                grid = np.where(whole[7:10] > 0, whole[7:10], n)
                pixel = real[10:13] / np.where(grid > 0, grid, 1)
                rows.append((name, *map(int, n), int(whole[3]), HEADER_BYTES + int(whole[23]), *map(float, pixel)))
            yield pd.DataFrame(rows, columns=["path", "nx", "ny", "nz", "mode", "data_offset", "pixel_x", "pixel_y", "pixel_z"])

    return list_files(spark, path).select("path").repartition(F.col("path")).mapInPandas(parse, HEADER_SCHEMA)


def read_slices(headers: DataFrame) -> DataFrame:
    """All slices of the catalogued stacks: ``(stack, slice, ny, nx, px)``, 0-based."""
    size = F.create_map(*[x for m, t in STACK_MODES.items() for x in (F.lit(m), F.lit(np.dtype(t).itemsize))])
    width = F.try_element_at(size, F.col("mode"))
    checked = F.when(width.isNull(), F.raise_error(F.concat(F.lit("unsupported pixel type "), F.col("mode").cast("string"))).cast("int")).otherwise(width)
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGE_BYTES) / (F.col("nx") * F.col("ny") * F.col("_w")))).cast("int")
    ranges = (
        headers.withColumn("_w", checked)
        .withColumn("_step", step)
        .filter("nz > 0")
        .withColumn("first", F.explode(F.sequence(F.lit(0), F.col("nz") - 1, F.col("_step"))))
        .select("path", "nx", "ny", "mode", "data_offset", "first", F.least(F.col("_step"), F.col("nz") - F.col("first")).alias("count"))
    )

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                kind = np.dtype(STACK_MODES[r.mode])
                plane = r.nx * r.ny
                with _open(r.path) as f:
                    f.seek(r.data_offset + int(r.first) * plane * kind.itemsize)
                    data = np.frombuffer(f.read(int(r.count) * plane * kind.itemsize), kind)
                if data.size != r.count * plane:
                    raise ValueError(f"{r.path} ends early")
                yield pd.DataFrame(
                    {"stack": r.path, "slice": np.arange(r.first, r.first + r.count, dtype=np.int32), "ny": np.int32(r.ny), "nx": np.int32(r.nx),
                     "px": list(data.astype(np.float32).reshape(int(r.count), plane))}
                )

    return _spread(ranges).mapInPandas(read, "stack string, slice int, ny int, nx int, px array<float>")


def slice_voxels(slices: DataFrame) -> DataFrame:
    """Slices as voxel rows ``(stack, z, y, x, v)``."""
    return slices.select("stack", F.col("slice").alias("z"), "nx", F.posexplode("px").alias("i", "v")).select(
        "stack", "z", F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), (F.col("i") % F.col("nx")).alias("x"), F.col("v").cast("double").alias("v")
    )


def read_structured(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of structured arrays in ``.npy`` files with ``_file`` and ``_row``.

    ``fields`` maps array fields to Spark types (``array<double>`` for vector fields). Row
    ranges are read apart, so one large file uses many tasks.
    """

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name in part["path"]:
                with _open(name) as f:
                    head = f.read(12)  # magic, version, and the header's length in 2 or 4 bytes
                    long = head[6:7] != b"\x01"
                    size = int.from_bytes(head[8 : 12 if long else 10], "little") + (12 if long else 10)
                    head = io.BytesIO(head + f.read(size - 12))
                np.lib.format.read_magic(head)
                parse = np.lib.format.read_array_header_2_0 if long else np.lib.format.read_array_header_1_0
                shape, _, kind = parse(head, max_header_size=size)
                rows.append((name, head.tell(), shape[0], kind.itemsize, repr(kind.descr)))
            yield pd.DataFrame(rows, columns=["path", "offset", "rows", "width", "kind"])

    heads = list_files(spark, path).select("path").repartition(F.col("path")).mapInPandas(
        measure, "path string, offset bigint, rows bigint, width bigint, kind string"
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGE_BYTES) / F.col("width"))).cast("bigint")
    ranges = heads.filter("rows > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, step))).withColumn(
        "count", F.least(step, F.col("rows") - F.col("first"))
    )

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for part in parts:
            for r in part.itertuples(index=False):
                kind = np.dtype([tuple(d) for d in ast.literal_eval(r.kind)])
                with _open(r.path) as f:
                    f.seek(r.offset + r.first * r.width)
                    data = np.frombuffer(f.read(int(r.count * r.width)), kind)
                out = {"_file": r.path, "_row": np.arange(r.first, r.first + r.count)}
                for name in fields:
                    col = data[name]
                    if col.dtype.kind == "S":
                        col = np.char.decode(col, "utf-8")
                    out[name] = list(col) if col.ndim > 1 or col.dtype.kind in "US" else col
                yield pd.DataFrame(out)

    schema = ", ".join(["_file string", "_row bigint", *[f"`{n}` {t}" for n, t in fields.items()]])
    return _spread(ranges).mapInPandas(read, schema)
