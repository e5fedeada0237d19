"""Counts, group tables and statistics of particle tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.functions.angles import angle_bins, direction_distance2
from motes.operators.checks import require
from motes.functions.keys import last_parts, stack_name
from motes.operators.ordered import position


def count_halves(df: DataFrame, subset: str = "subset") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(subset) == 1).alias("half1"),
        F.count_if(F.col(subset) == 2).alias("half2"),
    )


def micrograph_counts(df: DataFrame, mic: str | None = "mic", image: str = "image", depth: int = 0) -> DataFrame:
    """Particles per micrograph; the stack stands in for a missing micrograph column."""
    source = F.col(mic) if mic and mic in df.columns else stack_name(F.col(image))
    return df.groupBy(last_parts(source, depth).alias("micrograph")).agg(F.count(F.lit(1)).alias("n"))


def micrograph_coordinates(df: DataFrame, mic: str = "mic", x: str = "x", y: str = "y", order: str = "_row") -> DataFrame:
    """Coordinates with their place in the micrograph's list, one row each.

    Rows instead of one list per micrograph: a list of a micrograph with a third of all
    particles would not fit a task. Write with ``partitionBy`` for a file per micrograph.
    """
    return position(df.select(order, mic, x, y), [mic], order, "place")


def first_of_key(df: DataFrame, keys: Sequence[str], order: str = "_row") -> DataFrame:
    """Drop repeats of a key, keeping the first row; merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_first"))
        .select(*keys, *[F.col("_first")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def dense_ids(df: DataFrame, key: Column, order: str = "_row", out: str = "id") -> DataFrame:
    """Number the distinct values of ``key`` 1, 2, ... by first appearance.

    Returns the dimension (``key``, first ``_row``, id). Distinct keys are numbered in
    ordered chunks, so many keys are fine too.
    """
    firsts = df.groupBy(key.alias("key")).agg(F.min(order).alias("_row"))
    return position(firsts, [], "_row", "_pos").select("key", "_row", (F.col("_pos") + 1).alias(out))


def optics_from_folders(df: DataFrame, folder: Column, fields: Sequence[str], order: str = "_row"):
    """One optics row per folder with the fields of its first particle, and mapped particles."""
    tagged = df.withColumn("_folder", folder)
    ids = dense_ids(tagged, F.col("_folder"), order, "optics_group").withColumnRenamed("key", "_folder")
    firsts = tagged.groupBy("_folder").agg(F.min_by(F.struct(*fields), order).alias("f"))
    optics = ids.join(firsts, "_folder").select(
        "optics_group", F.col("_folder").alias("optics_name"), *[F.col("f")[c].alias(c) for c in fields]
    )
    mapped = tagged.join(ids.select("_folder", "optics_group"), "_folder", "left").drop("_folder")
    return optics, mapped


def difference_statistics(a: DataFrame, b: DataFrame, order: str = "_row", compat: bool = True) -> DataFrame:
    """Mean and sample deviation of angle, origin and psi differences of two tables.

    One row for all particles (half NULL) and one per half. ``*_sd_global`` is the spread
    of a half about the mean over all particles, which older reports show.
    """
    other = b.select(order, F.lit(True).alias("_theirs"), *[F.col(c).alias(f"_{c}") for c in ("rot", "tilt", "psi", "x", "y")])
    d2 = direction_distance2(F.col("rot"), F.col("tilt"), F.col("_rot"), F.col("_tilt"), compat)
    both = a.withColumn("_mine", F.lit(True)).join(other, order, "full_outer")
    diffs = require(both, F.col("_mine") & F.col("_theirs"), "a row number is in one table only").select(
        "subset",
        F.degrees(F.sqrt(d2)).alias("angle"),
        F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)).alias("origin"),
        F.abs(F.col("psi") - F.col("_psi")).alias("psi"),
    )
    names = ["angle", "origin", "psi"]
    parts = [F.count(F.lit(1)).alias("n")]
    for c in names:
        parts += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.var_pop(c).alias(f"_{c}_var")]
    # three rows: both halves and their total
    stats = diffs.rollup("subset").agg(*parts)
    three = Window.partitionBy(F.lit(0))
    for c in names:
        centre = F.max(F.when(F.col("subset").isNull(), F.col(f"{c}_mean"))).over(three)
        spread = F.col("n") * (F.col(f"_{c}_var") + F.pow(F.col(f"{c}_mean") - centre, 2))
        stats = stats.withColumn(f"{c}_sd_global", F.sqrt(F.try_divide(spread, F.col("n") - 1)))
    return stats.select(F.col("subset").alias("half"), "n", *[f"{c}_{s}" for c in names for s in ("mean", "sd", "sd_global")])


def row_means(tables: Sequence[DataFrame], columns: Sequence[str], order: str = "_row") -> DataFrame:
    """Mean of listed columns over tables of equal length, row by row."""
    k = len(tables)
    stacked = reduce(DataFrame.unionByName, [t.select(order, *columns) for t in tables])
    grouped = stacked.groupBy(order).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_k"))
    checked = F.when(F.col("_k") == k, F.lit(True)).otherwise(F.raise_error(F.lit("tables differ in length")).cast("boolean"))
    return grouped.filter(checked).drop("_k")


def angle_histogram(df: DataFrame, bins: int, rot: str = "rot", tilt: str = "tilt") -> DataFrame:
    """Counts per bin of the two wrapped viewing angles; only filled bins have a row."""
    bx, by = angle_bins(F.col(rot), F.col(tilt), bins)
    return df.select(bx.alias("bin_x"), by.alias("bin_y")).dropna().groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"))


def angle_bin_id(df: DataFrame, bins: int, rot: str = "rot", tilt: str = "tilt", out: str = "bin_id") -> DataFrame:
    bx, by = angle_bins(F.col(rot), F.col(tilt), bins)
    return df.withColumn(out, bx + F.lit(bins) * by)


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, extremes and sample deviation per column, one row each."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{s}_{c}").cast("double").alias(s) for s in ("mean", "min", "max", "sd")]) for c in columns])
    return wide.select(F.inline(rows))


def best_class(df: DataFrame, columns: Sequence[str] | None = None, out: str = "class") -> DataFrame:
    """Class with the highest score; the first column wins ties, no positive score gives -1.

    Columns default to those whose name ends in ``_class<number>``. Missing and NaN
    scores are skipped.
    """
    numbered = {c: int(m.group(1)) for c in (columns or df.columns) if (m := re.search(r"(?:^|_)class(\d+)$", c))}
    if not numbered:
        raise ValueError("no column ends in class<number>")
    scores = {c: F.nullif(F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))) for c in numbered}
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    pick = F.when(top.isNull() | (top <= 0), F.lit(-1))
    for c, number in numbered.items():
        pick = pick.when(scores[c] == top, F.lit(number))
    return df.withColumn(out, pick)


def best_table(tables: Sequence[DataFrame], score: str = "score", order: str = "_row") -> DataFrame:
    """1-based number of the table with the highest score per row; the first wins ties."""
    stacked = reduce(
        DataFrame.unionByName, [t.select(order, F.col(score).alias("score"), F.lit(i + 1).alias("class")) for i, t in enumerate(tables)]
    )
    return stacked.groupBy(order).agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("class"))

