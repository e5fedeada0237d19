"""Text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, rename: dict[str, str] | None = None) -> None:
    """CSV with header, optionally with other column names."""
    df.withColumnsRenamed(rename or {}).write.option("header", "true").csv(path)


def write_column(df: DataFrame, path: str, column: str, order: str = "_row") -> None:
    """One value per line, in row order."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.col(column).cast("string").alias("value")).write.text(path)


def direction_lines(df: DataFrame, rot: str = "rot", tilt: str = "tilt") -> DataFrame:
    """The two viewing angles as text lines."""
    return df.withColumn("value", F.format_string("%.6f %.6f", F.col(rot), F.col(tilt)))


def affine_rows(df: DataFrame, psi: str | None = "psi", x: str | None = "x", y: str | None = "y") -> DataFrame:
    """Per-row 2-D affine from in-plane angle and origin; leave one out to get no turn or shift."""
    a = F.radians(psi) if psi else F.lit(0.0)
    shift = [F.col(c).cast("double") if c else F.lit(0.0) for c in (x, y)]
    return df.withColumns({"a11": F.cos(a), "a12": -F.sin(a), "a21": F.sin(a), "a22": F.cos(a), "dx": shift[0], "dy": shift[1]})


def zero_origins(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({x: F.lit(0.0), y: F.lit(0.0)})


def append_rejects(rejected: DataFrame, path: str) -> None:
    """Add rejected image keys and reasons to a shared table; Spark commits whole writes."""
    rejected.write.mode("append").parquet(path)
