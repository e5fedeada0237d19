"""Similarity of images and maps.

Aggregate scores work on pixel rows. Scores that compare many images work on packs: rows
that hold a bounded number of whole images and bytes of pixels, so a task multiplies
two bounded matrices and no pair of images ever becomes a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.operators.ordered import join_on_keys, position
from motes.operators.similar import pack_size, unit_images


# --- pixel rows ------------------------------------------------------------


def _ncc(a: Column, b: Column) -> Column:
    """Correlation; 0 for no covariance, 1 for covariance without spread."""
    n = F.count(a + b)
    cov = F.covar_pop(a, b) * n
    spread = F.var_pop(a) * n * F.var_pop(b) * n
    return F.when(cov == 0, F.lit(0.0)).when(spread < 1e-10, F.lit(1.0)).otherwise(cov / F.sqrt(spread))


def _psnr(a: Column, b: Column, index: Column, masked: bool) -> Column:
    """Peak signal-to-noise; the first masked pixel counts but adds no error, and unmasked
    images count their pixels twice and have a peak of at least 0."""
    n = F.count(a + b)
    err = (a - b) * (a - b)
    if masked:
        total = F.sum(err) - F.min_by(err, F.when(a.isNotNull(), index))
        peak, mse = F.max(a), total / n
    else:
        peak, mse = F.greatest(F.max(a), F.lit(0.0)), F.sum(err) / (2 * n)
    value = 20 * F.log10(F.try_divide(peak, F.sqrt(mse)))
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def _ssim(a: Column, b: Column, span: float = 1.0) -> Column:
    """Structural similarity over the whole mask."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = F.avg(a), F.avg(b)
    return ((2 * ma * mb + c1) * (2 * F.covar_pop(a, b) + c2)) / ((ma * ma + mb * mb + c1) * (F.var_pop(a) + F.var_pop(b) + c2))


# Score names and their aggregate; mutual information and the structural score have own functions.
SCORES: dict[str, Callable[[Column, Column, Column, bool], Column]] = {
    "CC": lambda a, b, i, m: _ncc(a, b),
    "PSNR": _psnr,
    "SSIM": lambda a, b, i, m: _ssim(a, b),
}


def pair_scores(
    df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("CC", "PSNR", "SSIM"), a="a", b="b", index="i", mask: str | None = None, threshold=0.0
) -> DataFrame:
    """Scores of image pairs given as pixel rows, optionally where a mask exceeds a threshold."""
    inside = F.col(mask) > threshold if mask else F.lit(True)
    x, y = F.when(inside, F.col(a)), F.when(inside, F.col(b))
    return df.groupBy(*keys).agg(*[SCORES[n](x, y, F.col(index), mask is not None).alias(n) for n in names])


def mutual_information(df: DataFrame, keys: Sequence[str], bins: int, a="a", b="b", mask: str | None = None, threshold=0.0, out="MI") -> DataFrame:
    """Normalised mutual information (H1 + H2) / (2 H12) from equal-width joint bins."""
    used = df.filter(F.col(mask) > threshold) if mask else df
    ends = used.groupBy(*keys).agg(*[f(c).alias(f"_{t}{c}") for c in (a, b) for t, f in (("lo", F.min), ("hi", F.max))])
    placed = join_on_keys(used, ends, keys, "inner")

    def bin_of(c: str) -> Column:
        lo, hi = F.col(f"_lo{c}"), F.col(f"_hi{c}")
        return F.when(hi > lo, F.floor((F.col(c) - lo) * (bins - 1) / (hi - lo))).otherwise(F.lit(0))

    joint = placed.groupBy(*keys, bin_of(a).alias("_x"), bin_of(b).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    # both margins and the joint counts in one grouping of the (few) joint bins
    sides = {"_x": 1, "_y": 2, "_x_y": 0}  # by the bit of what is summed over
    sets = [[*keys, "_x"], [*keys, "_y"], [*keys, "_x", "_y"]]
    counts = joint.groupingSets(sets, *keys, "_x", "_y").agg(F.grouping_id().bitwiseAND(F.lit(3).cast("bigint")).alias("_side"), F.sum("_n").cast("double").alias("_n"))
    total = F.sum(F.when(F.col("_side") == 0, F.col("_n")))
    entropy = lambda side: F.log2(total) - F.sum(F.when(F.col("_side") == side, F.col("_n") * F.log2("_n"))) / total
    both = counts.groupBy(*keys).agg(*[entropy(side).alias(f"_h{name}") for name, side in sides.items()])
    value = F.when(F.abs("_h_x_y") > 1e-12, (F.col("_h_x") + F.col("_h_y")) / (2 * F.col("_h_x_y"))).otherwise(F.lit(0.0))
    return both.select(*keys, value.alias(out))


def weighted_correlation(df: DataFrame, keys: Sequence[str], a="a", b="b", weight="w", floor: float = 0.0, out="ncc") -> DataFrame:
    """Correlation under a soft mask, negative values cut to 0."""
    w = F.when(F.col(weight) > floor, F.col(weight)).otherwise(F.lit(0.0)) if floor > 0 else F.col(weight)
    x, y = F.col(a), F.col(b)
    means = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.try_divide(F.sum(w * x), F.sum(w)).alias("_a"), F.try_divide(F.sum(w * y), F.sum(w)).alias("_b"))
    x0, y0 = x - F.col("_a"), y - F.col("_b")
    sums = join_on_keys(df, means, keys, "inner").groupBy(*keys, "_w").agg(
        F.sum(w * x0 * y0).alias("_n"), (F.sqrt(F.sum(w * x0 * x0) * F.sum(w * y0 * y0)) + 1e-12).alias("_d")
    )
    cc = F.greatest(F.lit(0.0), F.col("_n") / F.col("_d"))
    return sums.select(*keys, F.when(F.col("_w") > 0, F.coalesce(F.nanvl(cc, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0)).alias(out))


# --- structural score ------------------------------------------------------


def _weighted_moments(images: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total weights, and weighted sums of products of centred images (2 x 2 per pair).

    ``images`` holds both members of every pair: (member, pair, y, x).
    """
    total = np.einsum("nyx->n", weights)
    mean = np.einsum("knyx,nyx->kn", images, weights) / np.where(total > 0, total, 1.0)
    centred = images - mean[:, :, None, None]
    return total, np.einsum("inyx,jnyx,nyx->nij", centred, centred, weights)


def _masked_agreement(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Correlation of each pair under its mask, 0 where it is negative or undefined."""
    total, moments = _weighted_moments(np.stack([a, b]), weights)
    spread = np.sqrt(moments[:, 0, 0] * moments[:, 1, 1]) + 1e-12
    value = np.clip(np.nan_to_num(moments[:, 0, 1] / spread, nan=0.0, posinf=0.0, neginf=0.0), 0.0, None)
    return value * (total > 0)


def structural_score(df: DataFrame, ny: int, nx: int, sigma: float = 1.0, key: str = "id", image="px", reference="ref", mask="w") -> DataFrame:
    """Product of correlations of an image pair and of its derivatives.

    Each row holds an image, its reference and a mask as arrays. Both images get their
    mean amplitude spectrum first; channels are the image and its x, y, xx and yy Gaussian
    derivatives. Works on Arrow batches of whole images.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fy, fx = np.meshgrid(np.fft.fftfreq(ny), np.fft.fftfreq(nx), indexing="ij")
        smooth = np.exp(-2 * np.pi**2 * sigma**2 * (fx**2 + fy**2))
        filters = [2j * np.pi * fx * smooth, 2j * np.pi * fy * smooth, -((2 * np.pi * fx) ** 2) * smooth, -((2 * np.pi * fy) ** 2) * smooth]
        for part in parts:
            if not len(part):
                continue
            a, b, w = (np.stack(part[c].to_numpy()).astype(np.float64).reshape(-1, ny, nx) for c in (image, reference, mask))
            fa, fb = np.fft.fft2(a), np.fft.fft2(b)
            ma, mb = np.abs(fa) + 1e-8, np.abs(fb) + 1e-8
            mean = (ma + mb) / 2
            a = np.fft.ifft2(fa * mean / ma).real.astype(np.float32)
            b = np.fft.ifft2(fb * mean / mb).real.astype(np.float32)
            score = _masked_agreement(a.astype(np.float64), b.astype(np.float64), w)
            fa, fb = np.fft.fft2(a), np.fft.fft2(b)
            for h in filters:
                pair = [np.fft.ifft2(h * f).real.astype(np.float32).astype(np.float64) for f in (fa, fb)]
                score = score * _masked_agreement(*pair, w)
            yield pd.DataFrame({key: part[key], "score": score})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, image, reference, mask).mapInPandas(batches, f"{key} {kind}, score double")


# --- packs of images -------------------------------------------------------


def _packs(df: DataFrame, key: str, group: Sequence[str], pack: int) -> DataFrame:
    """Whole images gathered into rows of at most ``pack`` images: ``(group, pack, ids, us)``."""
    placed = position(df, group, key, "_p", sparse=True).withColumn("pack", F.floor(F.col("_p") / pack).cast("bigint"))
    rows = placed.groupBy(*group, "pack").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), F.col("u")))).alias("_r"))
    return rows.select(*group, "pack", F.col("_r.id").alias("ids"), F.col("_r.u").alias("us"))


def correlation_matrix(maps: DataFrame, key: str = "map", pixels: str = "px", pack: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Correlation of every map with every map, or of every target with every map.

    The matrix is the result, so it has one row per pair; the work is done pack by pack.
    """
    pack = pack or pack_size(maps, pixels)
    right = _packs(unit_images(maps, key, pixels).select(key, "u"), key, [], pack)
    left = right if targets is None else _packs(unit_images(targets, key, pixels).select(key, "u"), key, [], pack)
    # every pack meets every pack: the left side names the right packs it needs
    n = right.agg(F.max("pack").alias("n")).scalar()
    pairs = left.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("bigint"), n))).join(
        right.select(F.col("pack").alias("_to"), F.col("ids").alias("ids2"), F.col("us").alias("us2")), "_to"
    )

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                a, b = np.stack(row.us), np.stack(row.us2)
                i, j = np.asarray(row.ids), np.asarray(row.ids2)
                cc = a @ b.T
                yield pd.DataFrame({"a": np.repeat(i, len(j)), "b": np.tile(j, len(i)), "cc": cc.ravel()})

    kind = maps.schema[key].dataType.simpleString()
    out = pairs.select("ids", "us", "ids2", "us2").mapInPandas(multiply, f"a {kind}, b {kind}, cc double")
    if targets is None:
        return out.withColumn("cc", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("cc")))
    return out
