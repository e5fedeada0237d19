"""The most similar other image, exactly, without multiplying every pair.

Images of zero mean and unit length are seen from a few orthogonal directions in which a bounded sample
spreads most. The product of two images is that of their coordinates there plus at most the
product of what is left of their lengths (Cauchy-Schwarz), whatever the directions are; they only
decide how much is saved. Images that are near in these coordinates are packed together, each first
meets its own pack, and a pack meets another only where the bound of the two exceeds the least that one
of its images has found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.operators.ordered import join_on_keys, ranked
from motes.session import checkpointed

PACK = 256
PACK_BYTES = 32 << 20
# Directions of the bound, and images of the sample that they come from.
DIRECTIONS = 8
SAMPLE = 2000
# Packs are dealt to so many shares, or more where these exceed the size.
SHARES = 8
SHARE_BYTES = 32 << 20
# Rounding of a bound; a little more is multiplied and nothing is missed.
MARGIN = 1e-9


def unit_images(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """Zero-mean, unit-length pixel arrays ``u`` with a fingerprint of their bytes.

    Flat images become all zero and have no fingerprint.
    """
    kind = df.schema[key].dataType.simpleString()

    def scale(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                v = np.stack(part[pixels].to_numpy()).astype(np.float64)
                largest = np.abs(v).max(1, keepdims=True)
                v -= v.mean(1, keepdims=True)
                norm = np.sqrt((v * v).sum(1, keepdims=True))
                # what is left of a flat image is rounding
                u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-12 * largest)
                marks = [hashlib.md5(r.tobytes()).hexdigest() if r.any() else None for r in u]
                yield pd.DataFrame({key: part[key], "u": list(u), "print": marks})

    return df.select(key, pixels).mapInPandas(scale, f"{key} {kind}, u array<double>, print string")


def pack_size(images: DataFrame, pixels: str) -> int:
    """How many images of this size fit a pack."""
    largest = images.agg(F.max(F.size(pixels)).alias("n")).first()["n"] or 1
    return max(1, min(PACK, PACK_BYTES // (8 * largest)))


def _directions(units: DataFrame, count: int) -> np.ndarray:
    """Orthonormal columns along which a sample spreads most. The sample is spread over the table by fingerprint."""
    sample = units.select("u").orderBy("print").limit(SAMPLE).collect()
    if not sample:
        return np.zeros((1, 1))
    return np.linalg.svd(np.array([r["u"] for r in sample]), full_matrices=False)[2][:count].T


def _interleaved(levels: np.ndarray, bits: int) -> np.ndarray:
    """One number a row whose high bits come from all columns in turn."""
    out = np.zeros(len(levels), np.int64)
    for bit in reversed(range(bits)):
        for column in levels.T:
            out = out << 1 | (column >> bit & 1)
    return out


def _seen(directions: np.ndarray, bits: int = 4):
    """Adds ``near``, by which images close to each other are packed together."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                t = np.stack(part["u"].to_numpy()) @ directions[:, :4]
                # in units of what a coordinate may be
                yield part.assign(near=_interleaved(np.clip((t + 1) * (1 << bits - 1), 0, (1 << bits) - 1).astype(np.int64), bits))

    return batches


def _first_look(key_kind: str, directions: np.ndarray):
    """A pack's own pairs, and what bounds its products with others."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                u, asks = np.stack(row.us), np.asarray(row.asks, bool)
                cc = u @ u.T
                np.fill_diagonal(cc, -np.inf)
                best = cc.argmax(1)
                top = cc[np.arange(len(u)), best]
                t = u @ directions
                rest = np.sqrt(np.maximum(0.0, 1.0 - (t * t).sum(1)))
                low = np.maximum(top, 0.0)[asks].min() if asks.any() else 2.0
                rows.append((list(np.asarray(row.ids)[best]), list(np.where(len(u) > 1, top, 0.0)), t.min(0).tolist(), t.max(0).tolist(), float(rest.max()), float(low)))
            if rows:
                yield part.assign(**{n: [r[i] for r in rows] for i, n in enumerate(("similar", "cc", "low_t", "high_t", "rest", "least"))})

    return batches


def _as_bytes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.assign(us=[np.stack(us).astype(np.float64).tobytes() for us in part["us"]])


def _bytes_schema(packs: DataFrame, group: Sequence[str], kind: str) -> str:
    named = ", ".join(f"`{c}` {packs.schema[c].dataType.simpleString()}" for c in group)
    rest = f"pack bigint, ids array<{kind}>, asks array<boolean>, cc array<double>, low_t array<double>, high_t array<double>, rest double, least double, us binary"
    return f"{named}, {rest}" if named else rest


def _shares(packs: DataFrame) -> int:
    """How many shares of bounded size the packs are dealt to; each meets each other in a task of its own."""
    seen = packs.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.size("ids").cast("bigint") * F.size(F.get("us", F.lit(0)))).alias("size")).first()
    return max(1, min(seen["n"], max(SHARES, -(-(seen["size"] or 0) // SHARE_BYTES))))


def _second_look(key: str, directions: np.ndarray):
    """What a pack's images find in another pack; pairs whose bound is too low are not multiplied."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                i, j = np.asarray(row.ids), np.asarray(row.ids2)
                a, b = np.frombuffer(row.us).reshape(len(i), -1), np.frombuffer(row.us2).reshape(len(j), -1)
                ta, tb = a @ directions, b @ directions
                ra, rb = (np.sqrt(np.maximum(0.0, 1.0 - (t * t).sum(1))) for t in (ta, tb))
                least = np.where(np.asarray(row.asks, bool), np.maximum(np.asarray(row.cc), 0.0), 2.0)
                wanted = ta @ tb.T + np.outer(ra, rb) >= least[:, None] - MARGIN
                rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
                if not len(rows):
                    continue
                cc = a[rows] @ b[columns].T
                # ids are sorted, so the first maximum is the lowest id
                best = cc.argmax(1)
                yield pd.DataFrame({key: i[rows], "similar": j[columns][best], "cc": cc[np.arange(len(rows)), best], "multiplied": len(columns)})

    return batches


def _tile_bound(size: int):
    """The most that a product between two packs can be."""
    corners = None
    for d in range(size):
        a = [F.col(c)[d] for c in ("low_t", "high_t")]
        b = [F.col(c)[d] for c in ("low_t2", "high_t2")]
        most = F.greatest(*[x * y for x in a for y in b])
        corners = most if corners is None else corners + most
    return corners + F.col("rest") * F.col("rest2")


def most_similar(images: DataFrame, group: Sequence[str], key: str = "id", pixels: str = "px", pack: int | None = None, work: bool = False) -> DataFrame:
    """For every image the other image of its ``group`` with the highest positive correlation: ``key``, ``similar``, ``cc``.

    ``group`` names the columns (a view, a class, a stack) within which images are compared; an empty list compares
    all with all. The result is that of all pairs; on equal correlations the lowest id wins. Copies of an image, however
    many, are merged first and point to each other (the lowest id, whose partner is the second lowest). Flat
    images and those without a positive partner have ``similar`` NULL and ``cc`` 0.

    Packs hold at most ``pack`` images; no task holds more than two, and of two packs only the bounds meet
    unless these leave something to find. ``work`` adds ``multiplied``, the images that each was multiplied with.
    """
    pack = pack or pack_size(images, pixels)
    group = list(group)
    kind = images.schema[key].dataType.simpleString()
    units = unit_images(images, key, pixels).filter("print is not null")
    if group:
        units = units.join(images.select(key, *group), key)
    units = checkpointed(units)
    same = [*group, "print"]

    groups = units.groupBy(*same).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = join_on_keys(units.select(key, *same), groups.filter("_n > 1").drop("_n"), same, "inner")
    second = copies.filter(F.col(key) != F.col("_first")).groupBy(*same).agg(F.min(key).alias("_second"))
    twins = join_on_keys(copies, second, same, "inner").select(
        key, F.when(F.col(key) == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("similar"), F.lit(1.0).alias("cc"), F.lit(0).cast("bigint").alias("multiplied")
    )

    directions = _directions(units, DIRECTIONS)
    singles = units.join(groups.select(F.col("_first").alias(key), (F.col("_n") == 1).alias("asks")), key).select(key, "u", "asks", *group)
    near = singles.mapInPandas(_seen(directions), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in singles.schema) + ", near bigint")
    placed = ranked(near, group, "near", tie=key, out="_p").withColumn("pack", F.floor(F.col("_p") / pack).cast("bigint"))
    rows = placed.groupBy(*group, "pack").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "u", "asks"))).alias("_r"))
    packs = rows.select(*group, "pack", F.col("_r.id").alias("ids"), F.col("_r.u").alias("us"), F.col("_r.asks").alias("asks"))
    found = f"similar array<{kind}>, cc array<double>, low_t array<double>, high_t array<double>, rest double, least double"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packs.schema)
    looked = checkpointed(packs.mapInPandas(_first_look(kind, directions), f"{fields}, {found}"))

    # Each share of the packs reads each other share from the checkpoint, so nothing is shuffled per pair of packs; the
    # bounds decide which pairs go on, with the pixels as bytes.
    last = looked.groupBy(*group).agg(F.max("pack").alias("_last"))
    shared = join_on_keys(looked, last, group, "inner").filter("_last > 0") if group else looked
    packed = shared.select(*group, "pack", "ids", "asks", "cc", "low_t", "high_t", "rest", "least", "us").mapInPandas(_as_bytes, _bytes_schema(shared, group, kind))
    shared = checkpointed(packed.repartition(_shares(shared)))
    others = shared.select(*[F.col(c).alias(f"{c}2") for c in (*group, "pack", "ids", "us", "low_t", "high_t", "rest")])
    meet = (F.col("pack") != F.col("pack2")) & (_tile_bound(directions.shape[1]) >= F.col("least") - MARGIN)
    for c in group:
        meet = F.col(c).eqNullSafe(F.col(f"{c}2")) & meet
    pairs = shared.filter("least <= 1").join(others.hint("shuffle_replicate_nl"), meet, "inner").select("ids", "us", "asks", "cc", "ids2", "us2")
    elsewhere = pairs.mapInPandas(_second_look(key, directions), f"{key} {kind}, similar {kind}, cc double, multiplied bigint")
    own = looked.select(F.explode(F.arrays_zip("ids", "similar", "cc", "asks")).alias("_o"), F.size("ids").alias("_m")).filter("_o.asks")
    at_home = own.select(F.col("_o.ids").alias(key), F.col("_o.similar").alias("similar"), F.col("_o.cc").alias("cc"), F.col("_m").cast("bigint").alias("multiplied"))

    best = at_home.unionByName(elsewhere).groupBy(key).agg(F.max(F.when(F.col("cc") > 0, F.struct("cc", (-F.col("similar")).alias("s")))).alias("_b"), F.sum("multiplied").alias("multiplied"))
    picked = best.select(key, (-F.col("_b.s")).alias("similar"), F.col("_b.cc").alias("cc"), "multiplied").unionByName(twins)
    out = images.select(key).join(picked, key, "left").withColumns({"cc": F.coalesce("cc", F.lit(0.0)), "multiplied": F.coalesce("multiplied", F.lit(0))})
    return out if work else out.drop("multiplied")
