"""Near duplicates: HyperMinHash registers, banded, estimated, and verified on full sets.

A document is the set of its word shingles. Hashes fall into buckets; of the smallest in
each, a register keeps the number of leading zeros and some bits of mantissa. Bands of
registers bring candidates together; registers estimate their similarity, corrected for
chance collisions; links count only after a comparison of the full sets.

Documents with equal sets are one class from the start, so copies cost nothing. In a band's
bucket each class is first compared with its most central one, which shares the most with
the rest: around a text that was copied with changes that is this text, and the copies join
through it. Once those links have made components, only classes of different components in
one bucket are compared, in bounded tiles: small sets as they are, large ones by a finer
sketch, and what may be similar is verified. So no link between components is missed, and
no pairs within one are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import n_words
from motes.llm.components import components
from motes.session import checkpointed

BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
MANTISSA = 20
# Two registers are equal by chance if their zeros (about a third) and mantissas are.
# Of the finer sketch that compares classes within a bucket: registers of one byte, 3 bits of
# zeros and 5 of mantissa. Sets of up to WHOLE shingles are compared as they are.
FINE = 1024
FINE_CHANCE = 2.0**-5 / 3
WHOLE = 256
# Standard errors of the estimate below the threshold at which a pair is still verified.
SLACK = 5
# Classes of a bucket that are compared with each other in one go.
TILE = 2000

_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _S)) * _K1
    x = (x ^ (x >> _S)) * _K2
    return x ^ (x >> _S)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of few words, the one of all."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    width = min(words, len(ws))
    n = len(ws) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mixed_bits(out ^ h[j : j + n]) + np.uint64(j)
    return np.unique(out)


def _smallest(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in use; leading zeros and the bits behind them of the smallest hash in each."""
    u = mixed_bits(hashes ^ np.uint64(0x9E3779B97F4A7C15))
    bucket = ((u >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.sort(bucket << np.uint64(32) | u & np.uint64(0xFFFFFFFF))
    bucket = order >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = (order[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    zeros = np.where(low > 0, 32 - np.frexp(np.maximum(low, 1))[1], 32)
    return bucket[first].astype(np.int64), zeros, low << (zeros + 1) & 0xFFFFFFFF


def registers(hashes: np.ndarray) -> np.ndarray:
    """One 32-bit register a bucket: 0 where it is empty, else 1 + (zeros, mantissa)."""
    out = np.zeros(REGISTERS, np.uint32)
    if len(hashes):
        bucket, zeros, mantissa = _smallest(hashes, REGISTERS)
        out[bucket] = (zeros << MANTISSA | mantissa >> (32 - MANTISSA)) + 1
    return out


def fine_registers(hashes: np.ndarray) -> np.ndarray:
    """More and shorter registers; 0 is an empty one (and stands for 1 as well)."""
    out = np.zeros(FINE, np.uint8)
    bucket, zeros, mantissa = _smallest(hashes, FINE)
    out[bucket] = np.maximum((zeros & 7) << 5 | mantissa >> 27, 1)
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each band (rows: sketches), and whether it has a register that isn't empty."""
    r = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
    for j in range(ROWS):
        key = mixed_bits(key * np.uint64(0x9E3779B97F4A7C15) ^ r[:, :, j])
    return key, r.any(axis=2)


def estimated(one: np.ndarray, many: np.ndarray, chance: float) -> np.ndarray:
    """Jaccard estimates: equal registers among those in use, less what chance makes equal."""
    used = (one != 0) | (many != 0)
    same = (one == many) & used
    share = same.sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def least_estimate(percent: int, registers: int) -> float:
    p = percent / 100
    return p - SLACK * (p * (1 - p) / registers) ** 0.5


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Of every row: set size, digest of the set and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, keys = [], [], []
            for value in batch.column(2):
                hashes = shingle_set(value.as_py(), words)
                sizes.append(len(hashes))
                sets.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                key, used = band_keys(registers(hashes))
                keys.append(key[used].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "digest", "n", "set", "keys"],
            )

    one = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).cast("binary").alias("t"))
    return one.mapInArrow(sketch, "id long, digest long, n long, set binary, keys array<long>")


def _surely(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[bool, bool]:
    """Whether sets of short hashes may be similar, and whether they are even if a few of the equal ones differ."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return 100 * both >= percent * union, 100 * (both - 3) >= percent * (union + 3)


def _tile_pairs(percent: int):
    """Pairs of different components in a tile that are, or by the finer sketch may be, similar.

    The most similar first. Small sets are compared whole, by short hashes; of these pairs only
    such as join components are needed, fewer than there are classes.
    """
    least = least_estimate(percent, FINE)

    def pairs(table: pa.Table) -> pa.Table:
        ids = table["class"].to_numpy()
        comp = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        side = table["side"].to_numpy()
        proofs = table["proof"].to_pylist()
        sets = [np.frombuffer(p, np.uint32, offset=1) if p[0] else None for p in proofs]
        fine = np.stack([fine_registers(h.astype(np.uint64)) if h is not None else np.frombuffer(p, np.uint8, offset=1) for h, p in zip(sets, proofs)])
        one_block = not side.any()
        left = np.arange(len(ids)) if one_block else np.flatnonzero(side == 0)
        right = left if one_block else np.flatnonzero(side == 1)
        # at most half a tile squared, twelve bytes each
        values, ones, others = [], [], []
        for i in left:
            far = right[(comp[right] != comp[i]) & ((right > i) | (not one_block))]
            if len(far):
                value = estimated(fine[i], fine[far], FINE_CHANCE)
                near = value >= least
                values.append(value[near].astype(np.float32))
                others.append(far[near].astype(np.int32))
                ones.append(np.full(len(others[-1]), i, np.int32))
        if not values:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        value, one, other = np.concatenate(values), np.concatenate(ones), np.concatenate(others)
        root = list(range(int(comp.max()) + 1))

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        kept = []
        for k in np.argsort(-value, kind="stable"):
            i, j = one[k], other[k]
            x, y = top(comp[i]), top(comp[j])
            if x == y:
                continue
            if sets[i] is None or sets[j] is None:
                kept.append(k)
                continue
            may, surely = _surely(sets[i], sets[j], percent)
            if may:
                kept.append(k)
            if surely:
                root[x] = y
        a, b = ids[one[kept]], ids[other[kept]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return pairs


def _open_pairs(busy: DataFrame, full: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a bucket but no component yet."""
    named = busy.join(labels, F.col("class") == F.col("id"), "left").select("bucket", "class", F.coalesce("label", "class").alias("label"))
    still = named.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("members"),
    )
    # buckets of several bands that hold the same classes have the same pairs: one of them is enough
    one = still.filter("lo != hi").groupBy("size", "members").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.col("size") / TILE)
    rows = named.join(checkpointed(one.select("bucket", blocks.alias("blocks"))), "bucket")
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = rows.select(
        "bucket", "class", "label",
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    ).join(full.select("class", "proof"), "class")
    return tiles.groupBy("bucket", "x", "y").applyInArrow(_tile_pairs(percent), "a long, b long").distinct()


def _full_sets(classes: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``hashes`` of the full set of each of ``classes`` (class, row), and ``proof``: half of
    each hash again if the set is small (first byte 1), else its finer registers (0)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(v.as_py(), words) for v in batch.column(1)]
            short = [np.unique(f.astype(np.uint32)) for f in found]
            proofs = [b"\1" + h.tobytes() if len(h) <= WHOLE else b"\0" + fine_registers(h.astype(np.uint64)).tobytes() for h in short]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(proofs, pa.binary())],
                names=["class", "hashes", "proof"],
            )

    row = F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("digest")).alias("row")
    texts = docs.select(row, F.col(text).cast("binary").alias("t")).join(classes, "row").select("class", "t")
    return texts.mapInArrow(sets, "class long, hashes binary, proof binary").dropDuplicates(["class"])


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(full.select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b")
    met = met.join(full.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a")
    return met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``id``, ``digest`` (of the text), ``n`` (set size), ``component`` and ``group`` of every row.

    ``component`` is the smallest id that can be reached over links of at least ``percent``
    Jaccard similarity. Null and blank texts have the empty set: each such row is a
    component of its own. Repeated rows and copies share a class. Rows with a null id take
    part; they get null where no id can be reached. ``group`` is a number of the component that rows without any id have
    too, null for an empty set. An empty table gives an empty one.
    """
    rows = checkpointed(_sketches(docs, key, text, words))
    classes = rows.groupBy("set").agg(
        F.min("id").alias("low"), F.min(F.struct("id", "digest")).alias("row"), F.max("n").alias("n"), F.max("keys").alias("keys")
    )
    # kept with the classes, so that each has one number from here on
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))
    bands = classes.select("class", "n", F.explode("keys").alias("bucket"))
    # kept apart from its aggregation, so that a crowded bucket is split in the join
    crowds = checkpointed(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    busy = checkpointed(bands.join(crowds, "bucket").select("bucket", "class", "n", "size"))
    # what others were copied from shares most buckets with most of them: it heads its buckets
    central = busy.groupBy("class").agg(F.sum("size").alias("weight"))
    heads = busy.join(central, "class").groupBy("bucket").agg(F.max(F.struct("weight", "class", "n")).alias("head"))
    busy = checkpointed(busy.join(checkpointed(heads), "bucket").select("bucket", "class", "n", "head"))
    # sets of too different sizes can't be similar
    near = F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent
    star = busy.filter((F.col("class") != F.col("head.class")) & near)
    tested = checkpointed(star.select(F.least("class", "head.class").alias("a"), F.greatest("class", "head.class").alias("b")).distinct())
    shared = busy.select("class").distinct().join(classes.select("class", "row"), "class")
    full = checkpointed(_full_sets(shared, docs, key, text, words))
    links = checkpointed(_verified(tested, full, percent))
    labels = components(links)
    more = checkpointed(_open_pairs(busy, full, labels, percent).join(tested, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = checkpointed(links.union(_verified(more, full, percent)))
        labels = components(links)
    named = classes.join(labels, F.col("class") == F.col("id"), "left").select("set", "low", "n", F.coalesce("label", "class").alias("label"))
    lowest = named.filter("n > 0").groupBy("label").agg(F.min("low").alias("component"))
    found = named.join(lowest, "label", "left").select("set", "component", "label")
    full_set = F.col("n") > 0
    return rows.select("id", "digest", "n", "set").join(found, "set").select(
        "id", "digest", "n", F.when(full_set, F.col("component")).otherwise(F.col("id")).alias("component"), F.when(full_set, F.col("label")).alias("group")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with its own columns: that with the smallest id, ids before null.

    Of rows with this id and text one stays, whichever columns else they have. Null and blank texts are
    groups of their own and all stay. An empty table gives an empty one; the caller's columns may have any names.
    """
    found = near_duplicates(docs, key, text, words, percent).filter("group IS NOT NULL")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first"))
    stay = first.select(F.struct("first.id", "first.digest").alias("same"))
    box = docs.select(F.struct("*").alias("row"))
    blank = n_words(F.col(f"row.{text}")) == 0
    same = F.struct(F.col(f"row.{key}").cast("long").alias("id"), F.xxhash64(F.col(f"row.{text}")).alias("digest"))
    # equal rows meet where they lie, before anything is shuffled
    one = box.filter(~blank).groupBy(same.alias("same")).agg(F.first("row").alias("row"))
    return box.filter(blank).select("row.*").union(one.join(stay, "same", "left_semi").select("row.*"))
