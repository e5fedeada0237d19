"""Statistics and reductions of voxel tables ``(map, z, y, x, v)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.operators.bricks import cut_packed_boxes
from motes.operators.ordered import join_on_keys, order_statistics, percentiles

VOXEL = ("z", "y", "x")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def map_label(name: Column) -> Column:
    """The particle count in a map's file name."""
    base = F.substring_index(name, "/", -1)
    patterns = [r"(\d+)_(?:locres|locinfo)\.mrc$", r"(\d+)\.mrc$"]
    found = [F.nullif(F.regexp_extract(base, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.regexp_replace(base, r"\.[^.]*$", ""))


def inside_mask(df: DataFrame, mask: DataFrame | None, voxel: Sequence[str], threshold: float) -> DataFrame:
    """The voxels whose mask weight ``w`` is above the threshold; all of them without a mask."""
    if mask is None:
        return df
    return df.join(mask.filter(F.col("w") > threshold).select(*voxel), list(voxel), "left_semi")


def robust_statistics(
    df: DataFrame, keys: Sequence[str], value: str = "v", median: bool = False, mask: DataFrame | None = None, voxel: Sequence[str] = VOXEL, threshold: float = 0.2, **cutting
) -> DataFrame:
    """Robust spread of each map by position in sorted order, without interpolation.

    With a ``mask`` (``voxel`` columns and weight ``w``) only the voxels above the threshold count.

    Columns follow the resolution report: ``max`` is the best, i.e. numerically smallest,
    value (the third smallest), ``min`` the value at 92.5 percent.
    """
    df = inside_mask(df, mask, voxel, threshold)
    n = F.col("_n")
    picks = {
        "max": F.when(n > 4, F.lit(2)).otherwise(F.lit(0)),
        "highQuartile": F.floor(n / 4),
        "lowQuartile": F.floor(n * 3 / 4),
        "min": F.greatest(F.lit(0), F.least(n - 1, F.floor(n * F.lit(3.70 / 4.0)))),
    }
    if median:
        picks |= {"_m1": F.floor((n - 1) / 2), "_m2": F.floor(n / 2)}
    stats = order_statistics(df, keys, value, picks, **cutting)
    if median:
        return stats.withColumn("median", (F.col("_m1") + F.col("_m2")) / 2).select(
            *keys, "n", "max", "highQuartile", "median", "lowQuartile", "min"
        )
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return join_on_keys(stats, means, keys, "inner").select(*keys, "n", "max", "highQuartile", "mean", "lowQuartile", "min")


def percentile_summary(df: DataFrame, keys: Sequence[str], value: str = "v", **cutting) -> DataFrame:
    """Best (smallest), quartiles with interpolation, mean and worst; non-finite values ignored."""
    good = df.filter(_finite(value))
    quart = percentiles(good, keys, value, {"q25": 0.25, "q75": 0.75}, **cutting)
    ends = good.groupBy(*keys).agg(F.min(value).alias("best"), F.avg(value).alias("mean"), F.max(value).alias("worst"))
    return join_on_keys(ends, quart, keys, "inner").select(*keys, "best", "q25", "mean", "q75", "worst")


def resolution_report(df: DataFrame, name: str = "map_name", value: str = "v", **cutting) -> DataFrame:
    """One robust row per map, labelled by the particle count in its name.

    ``mask``, ``voxel`` and ``threshold`` as in ``robust_statistics``.
    """
    stats = robust_statistics(df, [name], value, **cutting)
    return stats.withColumn("numParticles", map_label(F.col(name)).try_cast("bigint")).select(
        "numParticles", name, "max", "highQuartile", "mean", "lowQuartile", "min"
    )


def best_per_voxel(df: DataFrame, keys: Sequence[str], resolution="resolution", count="count", payload=("h1", "h2")) -> DataFrame:
    """Best resolution per voxel with the map's count and values; the lower count wins ties."""
    best = df.filter(_finite(resolution)).groupBy(*keys).agg(
        F.min_by(F.struct(resolution, count, *payload), F.struct(resolution, count)).alias("_b")
    )
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in (resolution, count, *payload)])


def best_count_map(
    df: DataFrame, mask: DataFrame | None, volume: Sequence[str], voxel: Sequence[str] = VOXEL, resolution="resolution", count="count", threshold=0.2, by: Column | None = None
) -> DataFrame:
    """Particle count of the best resolution (finite, at least 0.5) per voxel.

    The smallest ``by`` wins (the resolution, unless given), then the smallest resolution and count.
    Voxels outside the mask or without a valid value get the volume's largest count.
    """
    valid = _finite(resolution) & (F.col(resolution) >= 0.5)
    if mask is not None:
        inside = mask.filter(F.col("w") > threshold).select(*volume, *voxel, F.lit(True).alias("_in"))
        df = df.join(inside, [*volume, *voxel], "left")
        valid = valid & F.col("_in").isNotNull()
    top = df.groupBy(*volume).agg(F.max(count).alias("_top"))
    best = df.groupBy(*volume, *voxel).agg(
        F.min_by(count, F.when(valid, F.struct((F.col(resolution) if by is None else by).alias("_by"), resolution, count))).alias("_best")
    )
    return best.join(top, list(volume)).select(*volume, *voxel, F.coalesce("_best", "_top").alias(count))


def histogram(df: DataFrame, keys: Sequence[str], bins: int, value: str = "v") -> DataFrame:
    """Counts per equal-width bin between each map's extremes; only filled bins have a row."""
    good = df.filter(_finite(value))
    ends = good.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.withColumns(
        {"low": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")), "high": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))}
    ).drop("_lo", "_hi")
    placed = join_on_keys(good, ends, keys, "inner")
    at = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, "low", "high", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins)


def histogram_extrema(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark bins that are higher (peak) or lower (trough) than both filled neighbours."""
    # at most one row per bin, so a group is small
    w = Window.partitionBy(*keys).orderBy("bin")
    marked = counts.withColumn("_a", F.lag("n").over(w)).withColumn("_b", F.lead("n").over(w))
    kind = F.when((F.col("n") > F.col("_a")) & (F.col("n") > F.col("_b")), F.lit("peak")).when(
        (F.col("n") < F.col("_a")) & (F.col("n") < F.col("_b")), F.lit("trough")
    )
    return marked.withColumn("kind", kind).drop("_a", "_b")


def clip_percentiles(df: DataFrame, keys: Sequence[str], low: float, high: float, value: str = "v", **cutting) -> DataFrame:
    """Keep values between two percentiles of their map."""
    q = percentiles(df, keys, value, {"_lo": low / 100, "_hi": high / 100}, **cutting).drop("n")
    return join_on_keys(df, q, keys, "inner").filter((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))).drop("_lo", "_hi")


def value_summary(df: DataFrame, keys: Sequence[str], value: str = "v", **cutting) -> DataFrame:
    """Count, mean, population deviation and five percentiles per map."""
    good = df.filter(_finite(value))
    q = percentiles(good, keys, value, {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}, **cutting)
    moments = good.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return join_on_keys(moments, q, keys, "inner")


def otsu_threshold(df: DataFrame, keys: Sequence[str], bins: int = 256, value: str = "v") -> DataFrame:
    """Threshold that best separates two classes of values; the value itself for flat maps."""
    counts = histogram(df, keys, max(16, bins), value)
    w = Window.partitionBy(*keys)  # at most one row per bin
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n, c = F.col("n").cast("double"), F.col("centre")
    steps = counts.withColumns(
        {
            "_w1": F.sum(n).over(upto),
            "_m1": F.sum(n * c).over(upto),
            "_w": F.sum(n).over(w),
            "_m": F.sum(n * c).over(w),
        }
    )
    w2 = F.col("_w") - F.col("_w1")
    gap = F.try_divide(F.col("_m1"), F.col("_w1")) - F.try_divide(F.col("_m") - F.col("_m1"), w2)
    between = F.when(w2 > 0, F.col("_w1") * w2 * gap * gap)
    best = steps.withColumn("_s", between).groupBy(*keys).agg(
        F.max_by("centre", F.struct("_s", -F.col("bin"))).alias("_t"), F.min("low").alias("_low"), F.count("_s").alias("_k")
    )
    return best.select(*keys, F.when(F.col("_k") > 0, F.col("_t")).otherwise(F.col("_low") + 0.5).alias("threshold"))


def split_at(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Voxels below and at or above each map's threshold."""
    return join_on_keys(df, thresholds, keys, "inner").groupBy(*keys, "threshold").agg(
        F.count_if(F.col(value) < F.col("threshold")).alias("below"), F.count_if(F.col(value) >= F.col("threshold")).alias("above")
    )


def mask_union(df: DataFrame, keys: Sequence[str], value: str = "v", threshold: float = 0.0) -> DataFrame:
    """1 where any map of the group exceeds the threshold."""
    return df.groupBy(*keys).agg(F.max(F.when(F.col(value) > threshold, 1).otherwise(0)).alias("inside"))


def across_maps(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Sum, mean and squared spread about the mean over maps, voxel by voxel."""
    return df.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("spread")
    )


def bounding_cube(df: DataFrame, keys: Sequence[str], padding: int, sizes: dict[str, int], value: str = "v", threshold: float = 0.1) -> DataFrame:
    """Padded cube around the mask, cut at the volume's border; upper ends are exclusive."""
    inside = F.col(value) > threshold
    ends = df.groupBy(*keys).agg(
        *[F.min(F.when(inside, F.col(a))).alias(f"_lo_{a}") for a in VOXEL], *[(F.max(F.when(inside, F.col(a))) + 1).alias(f"_hi_{a}") for a in VOXEL]
    ).filter(F.col("_lo_z").isNotNull())
    size = F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in VOXEL])
    half = F.floor(size / 2)
    cols = []
    for a in VOXEL:
        mid = F.floor((F.col(f"_hi_{a}") + F.col(f"_lo_{a}")) / 2)
        cols.append(F.greatest(mid - half - padding, F.lit(0)).cast("bigint").alias(f"{a}0"))
        cols.append(F.least(mid + half + size % 2 + padding, F.lit(sizes[a])).cast("bigint").alias(f"{a}1"))
    return ends.select(*keys, *cols)


def stack_statistics(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Extremes, mean and deviation about the mean of all pixels of a stack."""
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("rms"))


def normalise(df: DataFrame, keys: Sequence[str], method: str = "zscore", value: str = "v") -> DataFrame:
    """Zero mean and unit deviation, [0, 1], or sign-preserving [-1, 1]; flat maps become 0."""
    v = F.col(value)
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(value).alias("_a"), F.stddev_pop(value).alias("_b"))
        out = F.when(F.col("_b") > 0, (v - F.col("_a")) / F.col("_b"))
    elif method == "minmax":
        stats = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        out = F.when(F.col("_b") > F.col("_a"), (v - F.col("_a")) / (F.col("_b") - F.col("_a")))
    elif method == "signed":
        stats = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        out = F.when(v > 0, v / F.col("_b")).when(v < 0, (v - F.col("_a")) / (0.0 - F.col("_a")) - 1)
    else:
        raise ValueError(f"unknown method {method}")
    return join_on_keys(df, stats, keys, "inner").withColumn(value, F.coalesce(out, F.lit(0.0))).drop("_a", "_b")


def fitted_scale(df: DataFrame, keys: Sequence[str], image="a", projection="b", mask="w", threshold=0.1, clip: float | None = None) -> DataFrame:
    """Least-squares factor between an image and its projection inside a mask; 1 if undefined."""
    inside = F.col(mask) > threshold
    i, p = F.when(inside, F.col(image)), F.when(inside, F.col(projection))
    alpha = F.coalesce(F.try_divide(F.sum(i * p), F.sum(p * p)), F.lit(1.0))
    if clip:
        alpha = F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), alpha))
    return df.groupBy(*keys).agg(alpha.alias("scale"))


def cut_boxes(
    picks: DataFrame,
    volumes: DataFrame,
    sizes: DataFrame,
    box: int,
    radius: float | None = None,
    policy: str = "pad",
    pad_value: float = 0.0,
    keys: Sequence[str] = ("tomo",),
) -> DataFrame:
    """Cut a cube around each pick (``particle``, ``cz``, ``cy``, ``cx``): one output row per cube voxel.

    The boxes of ``bricks.cut_packed_boxes``, unpacked.
    """
    boxes = cut_packed_boxes(picks, volumes, sizes, box, radius, policy, pad_value, keys)
    voxel = boxes.select(*keys, "particle", F.posexplode("px").alias("_p", "v"))
    at = {"iz": F.floor(F.col("_p") / (box * box)), "iy": F.floor(F.col("_p") / box) % box, "ix": F.col("_p") % box}
    return voxel.select(*keys, "particle", *[c.cast("int").alias(n) for n, c in at.items()], "v")
