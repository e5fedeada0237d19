"""Approximate nearest neighbours: a forest of sorted hash strings.

Each tree gives a vector a string of 64 bits, the sides of random planes on which it lies;
the strings of a tree stand sorted, cut into pieces that lie over the cluster. A query descends
to its place in every tree, where the longest common prefixes are its neighbours. Then
all trees ascend together, one prefix length at a time, until together they
hold enough candidates; those are scored where their vectors lie, in every piece that the
prefix touches. So where a tree is cut changes no answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.session import checkpointed

TREES = 32
BITS = 64
# Candidates of a query over all trees: CANDIDATES * rows ** GROWTH. Vectors without any
# structure need this many for a recall of nine tenths; clustered ones far fewer.
CANDIDATES = 7.0
GROWTH = 0.8
# The planes are centred on a sample of so many vectors; all vectors are indexed.
SAMPLE = 20_000
ROWS_PER_TASK = 60_000
# The pieces of a tree are cut by so many vectors of the sample at least.
SAMPLE_PER_PIECE = 8


def planes(sample: np.ndarray, trees: int = TREES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Directions (one column a bit, tree by tree) and the sample's medians along them."""
    directions = np.random.default_rng(seed).standard_normal((sample.shape[1], trees * BITS))
    # tree by tree, so that the sample's sides need little memory
    middle = [np.median(sample @ directions[:, i : i + BITS], axis=0) for i in range(0, trees * BITS, BITS)]
    return directions, np.concatenate(middle)


def strings(vectors: np.ndarray, directions: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Hash strings as numbers that sort like them: one row a vector, one column a tree."""
    side = vectors @ directions > middle
    packed = np.packbits(side.reshape(len(vectors), -1, BITS), axis=2)
    return np.ascontiguousarray(packed).view(">u8")[:, :, 0].astype(np.uint64)


_SIGN = np.uint64(1 << 63)


def _signed(h: np.ndarray) -> np.ndarray:
    return (h ^ _SIGN).view(np.int64)


def _unsigned(h: np.ndarray) -> np.ndarray:
    return h.view(np.uint64) ^ _SIGN


def prefix_ranges(sorted_strings: np.ndarray, queries: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share the first ``level`` bits with each query begin and end."""
    level = np.asarray(level, np.uint64)
    rest = np.where(level >= BITS, np.uint64(0), ~np.uint64(0) >> np.minimum(level, np.uint64(BITS - 1)))
    return (
        np.searchsorted(sorted_strings, queries & ~rest, "left"),
        np.searchsorted(sorted_strings, queries | rest, "right"),
    )


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


class Pieces:
    """Where each tree is cut: first string and class of each piece but the first, tree by tree.

    A piece is a stretch of a tree, numbered tree by tree. The bounds come from a sample, so
    that everyone can tell a string's piece and the pieces that a prefix touches.
    """

    def __init__(self, hashes: np.ndarray, cls: np.ndarray, pieces: int):
        self.per_tree = pieces
        at = np.arange(1, pieces) * len(cls) // pieces
        order = [np.lexsort((cls, hashes[:, t]))[at] for t in range(hashes.shape[1])]
        self.hash = [hashes[o, t] for t, o in enumerate(order)]
        self.cls = [cls[o] for o in order]

    def of(self, tree: int, hashes: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The piece of each string within its tree."""
        piece, above = (np.searchsorted(self.hash[tree], hashes, side) for side in ("left", "right"))
        # one string may fill several pieces; the class tells which
        for a, b in {*zip(piece[piece < above], above[piece < above])}:
            same = (piece == a) & (above == b)
            piece[same] = a + np.searchsorted(self.cls[tree][a:b], cls[same], "right")
        return piece

    def touched(self, tree: int, queries: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
        """First and last piece that may hold strings with the first ``level`` bits of each query."""
        return prefix_ranges(self.hash[tree], queries, level)


def _hashed(classes: DataFrame, directions: np.ndarray, middle: np.ndarray, pieces: Pieces, dim: int, with_vectors: bool) -> DataFrame:
    """Each class once per tree, in its piece, with null ``level``; and each class whose
    ``level`` is set also as a query, in every piece that it has to look into."""
    trees = directions.shape[1] // BITS

    def visits(tree: int, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which query goes to which piece."""
        if with_vectors:
            first, last = pieces.touched(tree, h, level)
            n = last - first + 1
            q = np.repeat(np.arange(len(h)), n)
            return q, np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        # for counts, the pieces in which a prefix of some length begins or ends
        ends = np.concatenate(pieces.touched(tree, h[:, None], np.arange(BITS + 1)[None, :]), axis=1)
        pair = np.unique((np.arange(len(h))[:, None] * pieces.per_tree + ends).ravel())
        return pair // pieces.per_tree, pair % pieces.per_tree

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                v = _rows(part, "vec").reshape(-1, dim)
                unit = v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
                h = strings(unit, directions, middle)
                cls = part.column(0).to_numpy()
                level = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                asks = np.flatnonzero(~np.isnan(level))
                at, piece, number, asked = [], [], [], []
                for t in range(trees):
                    q, there = visits(t, h[asks, t], level[asks].astype(np.uint64))
                    at += [np.arange(len(v)), asks[q]]
                    piece += [t * pieces.per_tree + pieces.of(t, h[:, t], cls), t * pieces.per_tree + there]
                    number += [h[:, t], h[asks[q], t]]
                    asked += [np.full(len(v), np.nan), level[asks[q]]]
                at, asked = np.concatenate(at), np.concatenate(asked)
                rows = pa.array(at)
                columns = [
                    pa.array(np.concatenate(piece).astype(np.int64)), pa.array(_signed(np.concatenate(number))), part.column(0).take(rows),
                    pa.array(np.nan_to_num(asked).astype(np.int32), mask=np.isnan(asked)),
                ]
                names = ["piece", "hash", "cls", "level"]
                if with_vectors:
                    columns.append(pa.array([row.tobytes() for row in v], pa.binary()).take(rows))
                    names.append("vec")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "piece long, hash long, cls long, level int" + (", vec binary" if with_vectors else "")
    return classes.select("cls", "vec", "level").mapInArrow(hashes, schema)


def _by_piece(hashed: DataFrame, pieces: int):
    return hashed.repartition(pieces, "piece").groupBy("piece")


def _parts(table: pa.Table) -> tuple[int, pa.Table, pa.Table]:
    """A piece's number, its strings in order, and the queries that look into it."""
    asks = pc.is_valid(table["level"])
    strings_, queries = table.filter(pc.invert(asks)), table.filter(asks)
    order = np.lexsort((strings_["cls"].to_numpy(), strings_["hash"].to_numpy()))
    return table["piece"][0].as_py(), strings_.take(pa.array(order)), queries


def _level_counts(pieces: Pieces, before: np.ndarray):
    """Of each query: how many strings share so many bits with it, piece by piece.

    ``before`` tells how many strings stand before each piece; whole pieces inside a prefix's
    range are added where the range begins, so nobody has to look into them.
    """

    def count(table: pa.Table) -> pa.Table:
        number, strings_, queries = _parts(table)
        tree, piece = divmod(number, pieces.per_tree)
        hashes, mine = _unsigned(strings_["hash"].to_numpy()), _unsigned(queries["hash"].to_numpy())
        cls = queries["cls"].to_numpy()
        out = []
        for level in range(BITS, -1, -1):
            first, last = pieces.touched(tree, mine, level)
            lo, hi = prefix_ranges(hashes, mine, level)
            n = np.where((piece == first) | (piece == last), hi - lo, 0)
            start = tree * pieces.per_tree
            between = before[start + last] - before[start + np.minimum(first + 1, last)]
            # a query does not count itself
            n = n + np.where(piece == first, between - 1, 0)
            some = n != 0
            out.append((cls[some], np.full(some.sum(), level, np.int32), n[some].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cls", "level", "n"])

    return count


def _scores(dim: int, dtype: str, k: int):
    def score(table: pa.Table) -> pa.Table:
        _, strings_, queries = _parts(table)
        read = lambda t: np.frombuffer(b"".join(t["vec"].to_pylist()), dtype).reshape(-1, dim).astype(np.float64)
        norm = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
        vectors, asking = read(strings_), read(queries)
        norms, own = norm(vectors), norm(asking)
        cls = strings_["cls"].to_numpy()
        lo, hi = prefix_ranges(_unsigned(strings_["hash"].to_numpy()), _unsigned(queries["hash"].to_numpy()), queries["level"].to_numpy().astype(np.uint64))
        out: list[tuple] = []
        for q, name, a, b in zip(range(len(asking)), queries["cls"].to_pylist(), lo, hi):
            # the sums of a row do not depend on the rows around it
            value = np.einsum("ij,j->i", vectors[a:b], asking[q]) / (norms[a:b] * own[q])
            ids = cls[a:b]
            if len(value) > k:
                good = np.flatnonzero(value >= np.partition(value, len(value) - k)[len(value) - k])
                good = good[np.lexsort((ids[good], -value[good]))[:k]]
            else:
                good = np.arange(len(value))
            out += [(name, c, s) for c, s in zip(ids[good], value[good])]
        return pa.table(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query", "cls", "score"]
        )

    return score


def nearest(
    vectors: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    trees: int = TREES,
    candidates: float = CANDIDATES,
    growth: float = GROWTH,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and cosine ``score`` of the nearest rows found.

    ``queries`` tells on ``key`` which rows ask. Equal vectors are one class in the forest, with its ``k + 1``
    smallest keys, all that any answer can hold: so copies cost nothing and ties go to the smaller key.
    Rows with a null key, or whose vector is null, zero, of another length than most, or
    holds a null or a number that isn't finite, take no part. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    v = F.col("vec")
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), queries.alias("asks"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = base.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    sizes = valid.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dim = sizes["dim"]
    valid = valid.filter(F.size("vec") == dim)
    smallest = Window.partitionBy("vec").orderBy("id")
    classes = (
        valid.select("id", "vec").distinct().withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("members"))
        .select(F.col("members")[0].alias("cls"), "vec", "members")
    )
    classes = checkpointed(classes)
    asking = valid.filter("asks").select(F.col("id").alias("query_id"), "vec").distinct()
    asking = checkpointed(asking.join(classes.select("vec", "cls"), "vec").select("query_id", "cls"))

    n = classes.count()
    per_tree = max(1, -(-n // ROWS_PER_TASK))
    sample = classes.select("cls", "vec").orderBy(F.xxhash64("cls")).limit(max(SAMPLE, SAMPLE_PER_PIECE * per_tree)).toArrow()
    names = sample["cls"].to_numpy()
    sample = sample["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    dtype = sample.dtype.str
    unit = sample / np.linalg.norm(sample.astype(np.float64), axis=1, keepdims=True)
    directions, middle = planes(unit[:SAMPLE], trees)
    cut = Pieces(np.concatenate([strings(unit[i : i + 256], directions, middle) for i in range(0, len(unit), 256)]), names, per_tree)
    tasks = per_tree * trees
    enough = candidates * n**growth

    before = np.zeros(tasks + 1, np.int64)
    if per_tree > 2:
        # only then can a prefix's range hold whole pieces
        sizes = _hashed(classes.withColumn("level", F.lit(None).cast("int")), directions, middle, cut, dim, False).groupBy("piece").count().collect()
        for r in sizes:
            before[r["piece"] + 1] = r["count"]
        before = np.cumsum(before)
    marked = classes.join(asking.select("cls").distinct().withColumn("level", F.lit(0)), "cls", "left")
    counts = _by_piece(_hashed(marked, directions, middle, cut, dim, False), tasks).applyInArrow(_level_counts(cut, before), "cls long, level int, n long")
    total = counts.groupBy("cls", "level").agg(F.sum("n").alias("n"))
    # the longest prefix at which all trees together hold enough; else the whole trees
    stop = total.filter(F.col("n") >= enough).groupBy("cls").agg(F.max("level").alias("stop"))
    levels = checkpointed(asking.select("cls").distinct().join(stop, "cls", "left").select("cls", F.coalesce("stop", F.lit(0)).alias("level")))

    placed = _by_piece(_hashed(classes.join(levels, "cls", "left"), directions, middle, cut, dim, True), tasks)
    found = placed.applyInArrow(_scores(dim, dtype, k + 1), "query long, cls long, score double")
    best = found.groupBy("query", "cls").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    best = best.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k + 1)
    rows = best.join(classes.select("cls", "members"), "cls").select("query", "score", F.explode("members").alias("vec_id"))
    lists = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    answers = asking.join(lists, asking["cls"] == lists["query"]).select(
        "query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found")
    )
    return answers.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )
