"""Iteration histories of selection runs, many sessions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.operators.ordered import CHUNK_ROWS, running


def iteration_history(
    df: DataFrame,
    keys: Sequence[str] = ("session",),
    order: str = "iteration",
    metric: str = "metric",
    count: str = "n",
    stability: bool = False,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Best metric so far, whether a row improved on it, and rows in a row without progress.

    Each session's first row is its baseline. Progress is a strictly lower metric, or,
    with ``stability``, a chosen count that differs from the row before.
    """
    keys = list(keys)
    seen = running(
        df,
        keys,
        order,
        {"best_before": ("min", F.col(metric)), "_n_before": ("sum", F.lit(1).cast("bigint"))},
        inclusive=False,
        chunk=chunk,
    )
    seen = seen.withColumn("_at", F.coalesce("_n_before", F.lit(0)))
    first = F.col("_at") == 0
    seen = seen.withColumn("improved", ~first & (F.col(metric) < F.col("best_before")))
    if stability:
        seen = running(seen, keys, order, {"_prev": ("lag", F.col(count))}, chunk=chunk)
        progress = first | (F.col(count) != F.col("_prev"))
    else:
        progress = first | F.col("improved")
    marked = seen.withColumn("_mark", F.when(progress, F.col("_at")))
    runs = running(marked, keys, order, {"_last": ("max", F.col("_mark"))}, chunk=chunk)
    return runs.withColumn("not_improved", F.col("_at") - F.col("_last")).withColumn(
        "best", F.least(metric, "best_before")
    ).drop("best_before", "_n_before", "_at", "_prev", "_mark", "_last")


def retained_share(df: DataFrame, keys: Sequence[str] = ("session",), order: str = "iteration", count: str = "n", metric: str = "metric") -> DataFrame:
    """Percentage of the session's first count, and change of the metric since then."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(count, metric), order).alias("_f"))
    joined = df.join(first, list(keys))
    return joined.withColumns(
        {
            "retained_pct": F.try_divide(F.col(count) * 100.0, F.col("_f")[count]),
            "metric_delta": F.col(metric) - F.col("_f")[metric],
        }
    ).drop("_f")


def merge_results(first: DataFrame, second: DataFrame, keys: Sequence[str], count: str, metric: str) -> DataFrame:
    """Rows of both result tables, one per (count, metric), the later table's on repeats."""
    rest = [c for c in first.columns if c not in (*keys, count, metric)]
    both = first.withColumn("_src", F.lit(1)).unionByName(second.withColumn("_src", F.lit(2)))
    return (
        both.groupBy(*keys, count, metric)
        .agg(F.max_by(F.struct(F.lit(1).alias("_one"), *rest), "_src").alias("_r"))
        .select(*keys, count, metric, *[F.col("_r")[c].alias(c) for c in rest])
    )


def best_and_largest(results: DataFrame, keys: Sequence[str], count: str, metric: str) -> DataFrame:
    """Per session the lowest metric with its count (smallest count on ties), and the largest
    count with its metric."""
    return results.groupBy(*keys).agg(
        F.min(F.struct(metric, count)).alias("_b"),
        F.max(count).alias("largest_n"),
        F.min_by(metric, F.struct(-F.col(count), metric)).alias("largest_metric"),
    ).select(*keys, F.col("_b")[count].alias("best_n"), F.col("_b")[metric].alias("best_metric"), "largest_n", "largest_metric")


def best_count(results: DataFrame, keys: Sequence[str], count: str, metric: str, order: str) -> DataFrame:
    """The tested count whose metric is lowest, the first row on ties."""
    return results.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(F.min_by(count, F.struct(metric, order)).alias("best_n"))


def threshold_crossing(df: DataFrame, keys: Sequence[str], freq: str, value: str, threshold: float, order: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """First place where the curve falls from at least ``threshold`` to below it.

    Interpolated linearly; NaN and NULL count as -1. Curves that never fall have no row.
    """
    clean = df.withColumn("_y", F.when(F.col(value).isNull() | F.isnan(value), F.lit(-1.0)).otherwise(F.col(value)))
    pairs = running(clean, list(keys), order, {"_b": ("lag", F.struct(F.col(freq).alias("f"), F.col("_y").alias("y")))}, chunk=chunk)
    falls = pairs.filter((F.col("_b")["y"] >= threshold) & (F.col("_y") < threshold))
    f1, y1 = F.col("_b")["f"], F.col("_b")["y"]
    at = f1 + (y1 - threshold) / (y1 - F.col("_y")) * (F.col(freq) - f1)
    out = falls.groupBy(*keys).agg(F.min_by(at, order).alias("frequency"))
    return out.filter("frequency > 0").withColumn("resolution", 1.0 / F.col("frequency"))


def next_settings(history: DataFrame, settings: DataFrame, keys: Sequence[str] = ("session",), order: str = "iteration") -> DataFrame:
    """Next smoothing width, early stop and subset switch from each session's latest row.

    ``history`` has ``sigma`` and ``not_improved``; ``settings`` has ``step``, ``floor``,
    ``decay_improved``, ``decay_not_improved``, ``stop_after`` and ``switch_after``.
    """
    last = history.groupBy(*keys).agg(F.max_by(F.struct("sigma", "not_improved"), order).alias("_l"))
    sigma, stalled = F.col("_l")["sigma"], F.col("_l")["not_improved"]
    decays = F.when(stalled > 0, F.col("decay_not_improved")).otherwise(F.col("decay_improved"))
    lowered = F.when(decays, sigma - F.col("step")).otherwise(sigma)
    return last.join(settings, list(keys)).select(
        *keys,
        F.round(F.greatest(lowered, F.col("floor")), 2).alias("next_sigma"),
        (stalled >= F.col("stop_after")).alias("stop"),
        (stalled > F.col("switch_after")).alias("switch_subset"),
    )

