"""Consistency checks of projects as tables of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = ("check", "status", "severity", "detail")


def check_rows(df: DataFrame, name: Column, passed: Column, severity: str, detail: Column) -> DataFrame:
    """One check result per row of ``df``."""
    return df.select(
        name.alias("check"), F.when(passed, F.lit("pass")).otherwise(F.lit("fail")).alias("status"), F.lit(severity).alias("severity"), detail.alias("detail")
    )


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*CHECK) for p in parts])


def verdict(checks: DataFrame) -> DataFrame:
    """Counts and the overall result: fine unless a critical check failed."""
    failed = F.col("status") == "fail"
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("severity") == "critical")).alias("critical"),
    ).withColumn("ok", F.col("critical") == 0)


def missing_columns(catalog: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Required blocks and columns that a file's block catalogue lacks."""
    spark = catalog.sparkSession
    wanted = spark.createDataFrame([(b, c) for b, cols in required.items() for c in cols], "block string, label string")
    have = catalog.select("file", "block", F.explode("labels").alias("label"))
    # a handful of required columns for every file
    need = catalog.select("file").distinct().select("file", F.explode(F.array(*[F.lit(b) for b in required])).alias("block")).join(wanted, "block")
    return need.join(have, ["file", "block", "label"], "left_anti").select("file", "block", "label")


def foreign_columns(catalog: DataFrame, block: str, prefix: str) -> DataFrame:
    """Columns of a block that start with a prefix that does not belong there."""
    return catalog.filter(F.col("block") == block).select("file", "block", F.explode("labels").alias("label")).filter(F.col("label").startswith(prefix))


def dangling_references(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose group the dimension lacks."""
    return fact.join(dimension.select(key), key, "left_anti")


def depth_check(headers: DataFrame, rows: DataFrame, key: str, what: str) -> DataFrame:
    """Whether each stack is as deep as its table has rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    both = headers.join(counts, key, "left")
    n = F.coalesce("_rows", F.lit(0))
    return check_rows(both, F.concat(F.lit(f"{what}:"), F.col(key).cast("string")), F.col("nz") == n, "critical", F.format_string("depth=%d rows=%d", "nz", n))


def pixel_check(headers: DataFrame, key: str) -> DataFrame:
    return check_rows(headers, F.concat(F.lit("pixel_size:"), F.col(key).cast("string")), F.col("pixel_x") > 0, "warning", F.format_string("pixel_x=%.4f", "pixel_x"))


def same_geometry(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """Whether two stacks agree in size and pixel size."""
    other = b.select(key, *[F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz", "pixel_x")])
    both = a.join(other, key)
    same = (F.col("nx") == F.col("_nx")) & (F.col("ny") == F.col("_ny")) & (F.col("nz") == F.col("_nz"))
    return both.select(key, same.alias("same_size"), (F.abs(F.col("pixel_x") - F.col("_pixel_x")) <= tolerance).alias("same_pixel"))
