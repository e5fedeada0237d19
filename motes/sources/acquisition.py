"""Small text files around tilt series: transforms, angles, acquisition and defocus notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.operators.ordered import position, running
from motes.sources.lines import line_table

AFFINE = ("a11", "a12", "a21", "a22", "dx", "dy")


def read_affine(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per-tilt affine rows; short lines are skipped and the rest numbered from 1."""
    parts = F.split("text", " ")
    rows = line_table(spark, path).filter(F.size(parts) >= 6)
    numbered = position(rows, ["file"], "at", "_n")
    return numbered.select("file", (F.col("_n") + 1).alias("tilt_index"), *[parts[i].cast("double").alias(c) for i, c in enumerate(AFFINE)])


def read_tilt_angles(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One tilt angle per line, numbered from 1."""
    return line_table(spark, path).select("file", (F.col("at") + 1).alias("tilt_index"), F.split("text", " ")[0].cast("double").alias("tilt_angle"))


def read_acquisition(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``key = value`` lines by section: ``(file, section, z, key, value)``.

    A ``[ZValue = n]`` line starts section n, another bracket line a section without
    number; lines before the first bracket belong to no section (NULL). The last value of
    a key in a section wins.
    """
    lines = line_table(spark, path)
    bracket = F.col("text").rlike(r"^\[.*\]$") & (~F.col("text").contains("=") | F.col("text").rlike(r"^\[\s*ZValue\s*=\s*\d+\s*\]$"))
    z = F.regexp_extract("text", r"ZValue\s*=\s*(\d+)", 1).try_cast("int")
    marked = lines.withColumn("_open", F.when(bracket, F.struct(F.col("at").alias("section"), z.alias("z"))))
    placed = running(marked, ["file"], "at", {"_in": ("max", F.col("_open"))})
    pairs = placed.filter(~bracket & F.col("text").contains("=")).select(
        "file",
        F.col("_in.section").alias("section"),
        F.col("_in.z").alias("z"),
        F.trim(F.substring_index("text", "=", 1)).alias("key"),
        F.trim(F.regexp_replace("text", r"^[^=]*=", "")).alias("value"),
        "at",
    )
    return pairs.groupBy("file", "section", "z", "key").agg(F.max_by("value", "at").alias("value"))


def read_commands(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``KEY rest-of-line`` command files as ``(file, key, value)``, the last value wins."""
    lines = line_table(spark, path).filter(~F.col("text").startswith("$"))
    value = F.when(F.instr("text", " ") > 0, F.regexp_replace("text", r"^\S+ ", "")).otherwise(F.lit(""))
    return lines.groupBy("file", F.substring_index("text", " ", 1).alias("key")).agg(F.max_by(value, "at").alias("value"))


def read_defocus(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Defocus by view range: ``(file, entry, view_start, view_end, angle_start, angle_end,
    defocus_u, defocus_v, astig_angle, phase_shift)``.

    A first line with six or more tokens and a zero in fifth place holds flags only. Seven
    tokens add astigmatism, eight a phase shift; unreadable lines are skipped.
    """
    lines = line_table(spark, path)
    t = F.split("text", " ")
    number = lambda i: F.try_element_at(t, F.lit(i + 1)).try_cast("double")
    flags = (F.col("at") == 0) & (F.size(t) >= 6) & F.coalesce(F.abs(number(4)) < 1e-6, F.lit(False))
    readable = (F.size(t) >= 5) & number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull() & number(4).isNotNull()
    rows = lines.filter(~flags & readable)
    wide = (F.size(t) >= 7) & number(5).isNotNull() & number(6).isNotNull()
    return position(rows, ["file"], "at", "entry").select(
        "file",
        "entry",
        number(0).cast("int").alias("view_start"),
        number(1).cast("int").alias("view_end"),
        number(2).alias("angle_start"),
        number(3).alias("angle_end"),
        number(4).alias("defocus_u"),
        F.when(wide, number(5)).otherwise(number(4)).alias("defocus_v"),
        F.when(wide, number(6)).otherwise(F.lit(0.0)).alias("astig_angle"),
        F.when(wide & (F.size(t) >= 8), F.coalesce(number(7), F.lit(0.0))).otherwise(F.lit(0.0)).alias("phase_shift"),
    )


def read_picks(spark: SparkSession, path: str | Sequence[str], kind: str = "csv", axis_order: str = "xyz") -> DataFrame:
    """Picked coordinates as ``(_file, _row, x, y, z)``.

    ``csv``: columns named x, y, z in any case, ``axis-0..2`` for z, y, x, or else the
    first three. ``points``: white-space separated numbers without header, in
    ``axis_order``. Unreadable numbers become NULL.
    """
    from motes.operators.tomography import reorder_axes

    lines = line_table(spark, path)
    cells = F.split(F.trim("text"), r"\s*[,;]\s*|\s+")
    if kind == "points":
        rows = lines.withColumn("_c", cells)
        values = [F.try_element_at("_c", F.lit(i + 1)).try_cast("double") for i in range(3)]
        x, y, z = reorder_axes(values, axis_order)
    elif kind == "csv":
        names = F.split(F.lower("text"), r"\s*[,;]\s*|\s+")
        spot = lambda n, axis, other: F.when(F.array_contains(names, n), F.array_position(names, n)).when(
            F.array_contains(names, axis), F.array_position(names, axis)
        ).otherwise(F.lit(other))
        heads = lines.filter("at = 0").select("file", *[spot(n, a, o).cast("int").alias(f"_i{n}") for n, a, o in (("x", "axis-2", 1), ("y", "axis-1", 2), ("z", "axis-0", 3))])
        rows = lines.join(heads, "file").filter("at > 0").withColumn("_c", cells)
        x, y, z = (F.try_element_at("_c", F.col(f"_i{n}")).try_cast("double") for n in "xyz")
    else:
        raise ValueError(f"unknown kind {kind}")
    return position(rows, ["file"], "at", "_row").select(F.col("file").alias("_file"), "_row", x.alias("x"), y.alias("y"), z.alias("z"))
