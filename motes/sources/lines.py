"""Text files as ordered line tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def line_table(spark: SparkSession, path: str | Sequence[str], significant: bool = True, previous: bool = False) -> DataFrame:
    """Lines as ``(file, at, text)``; ``at`` counts 0, 1, 2, ... through each file.

    With ``significant``, empty lines and ``#`` comments are left out and not counted.
    ``previous`` adds the line before, where both lie in the same split.

    Files are read in splits of bounded size, so one large file uses many tasks. Lines are
    numbered inside their split, in reading order, and the counts of the earlier splits
    are added. The numbers depend on the file alone, not on how it was split, so tables
    made in different jobs fit together.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_read"),
        F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"),
    )
    if significant:
        raw = raw.filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    per_file = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        raw.groupBy("file", "_start")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("file", "_start", F.coalesce(F.sum("_n").over(per_file), F.lit(0)).alias("_off"))
    )
    # one window group per split, never per file
    w = Window.partitionBy("file", "_start").orderBy("_read")
    numbered = raw.withColumn("_rn", F.row_number().over(w).cast("bigint") - 1)
    if previous:
        numbered = numbered.withColumn("previous", F.lag("text").over(w))
    out = numbered.join(offsets, ["file", "_start"]).withColumn("at", F.col("_off") + F.col("_rn"))
    return out.select("file", "at", "text", *(["previous"] if previous else []))


def list_files(spark: SparkSession, path: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Files below a path as ``(path, length, modified)`` plus one column per name pattern.

    File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", "length", F.col("modificationTime").alias("modified"))
    for name, pattern in (patterns or {}).items():
        listed = listed.withColumn(name, F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")))
    return listed
