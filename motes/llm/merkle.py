"""Merkle manifest of a dataset by time-forward processing.

Each row is a leaf; the leaves of a group stand in the order of a key, every two consecutive nodes
become one, and the tops of the groups, in the order of the group, likewise become the root.

A node is labelled by its level and its place, so labels ascend from children to parents. A sweep
forward in that order takes the messages for the smallest label from a priority queue, makes the
node's digest, and sends it to the parent's label. The queue is external: a task
holds the part for one block of 4096 consecutive nodes, a heap of at most that many messages; what
leaves a block waits in a table for the next round, which is dealt and sorted by the labels of the next
blocks. So a tree of n leaves takes log(n) / 12 rounds, and no group lies in one task.

The same blocks are then swept in reverse: what a top gets as the rest of its proof, its nodes get
with their own siblings before it, down to the leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from motes.llm.common import row_and
from motes.session import checkpointed

# Levels of the tree in one block.
LEVELS = 12


def joined_hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """H of the columns: ``-`` for null, else byte count, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def sweep(leaves: list[str], levels: int) -> tuple[list[str], int]:
    """The nodes that remain after ``levels`` levels or when one remains, and the levels done."""
    queue = [(0, place, digest) for place, digest in enumerate(leaves)]
    heapq.heapify(queue)
    left = len(leaves)  # nodes of the current level
    level = 0
    while left > 1 and level < levels:
        made = 0
        while queue and queue[0][0] == level:
            _, place, digest = heapq.heappop(queue)
            children = [digest]
            while queue and queue[0][0] == level and queue[0][1] >> 1 == place >> 1:
                children.append(heapq.heappop(queue)[2])
            heapq.heappush(queue, (level + 1, place >> 1, joined_hash(children)))
            made += 1
        left, level = made, level + 1
    return [digest for _, _, digest in sorted(queue)], level


def lifted(digest: str, levels: int) -> str:
    """A node without siblings, some levels further up."""
    for _ in range(levels):
        digest = joined_hash([digest])
    return digest


def proofs(leaves: list[str], levels: int) -> list[tuple[list[str], str]]:
    """Each leaf's siblings up to the block's top and, a letter a level, where they stand: ``l``
    before the node, ``r`` after it, ``-`` for none.

    The reversed sweep: labels descend, each node hands its own suffix, with the digest
    of its other child before it, to its children.
    """
    rows = [leaves]
    for _ in range(levels):
        last = rows[-1]
        rows.append([joined_hash(last[i : i + 2]) for i in range(0, len(last), 2)])
    suffix: list[tuple[list[str], str]] = [([], "") for _ in rows[-1]]
    for children in reversed(rows[:-1]):
        below = []
        for place in range(len(children)):
            digests, sides = suffix[place >> 1]
            other = place ^ 1
            if other < len(children):
                below.append(([children[other], *digests], ("l" if other < place else "r") + sides))
            else:
                below.append((digests, "-" + sides))
        suffix = below
    return suffix


def fold(leaf: str, siblings: list[str], sides: str) -> str:
    """The root that a leaf and its siblings give; this is all that a verifier needs."""
    others = iter(siblings)
    for side in sides:
        if side == "l":
            leaf = joined_hash([next(others), leaf])
        else:
            leaf = joined_hash([leaf, next(others)] if side == "r" else [leaf])
    return leaf


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in the run of rows of its group within the partition."""
    group, at = None, -1
    for batch in batches:
        places = []
        for g in batch.column("g").to_pylist():
            at = at + 1 if g == group else 0
            group = g
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "run"])


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, the number of each row in its group ``g`` by ``order``, from 0.

    One range sort of the whole table. Of each range, its first and last group and the number of
    rows in the latter pass the driver: one row a range. So a group may fill any number of ranges.
    """
    ranged = df.repartitionByRange("g", *order).sortWithinPartitions("g", *order).drop(*order)
    parted = ranged.withColumn("part", F.spark_partition_id())
    placed = checkpointed(parted.mapInArrow(_number, StructType([*parted.schema.fields, *StructType.fromDDL("run long").fields])))
    ends = placed.groupBy("part").agg(F.min("g").alias("first"), F.max(F.struct("g", "run")).alias("last"))
    carried, group, rows = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        before = rows if r.first == group else 0
        if before:
            carried.append((r.part, r.first, before))
        group, rows = r.last.g, r.last.run + 1 + (before if r.last.g == r.first else 0)
    carry = df.sparkSession.createDataFrame(carried, "part int, g string, carried long")
    joined = placed.join(F.broadcast(carry), ["part", "g"], "left")
    return joined.withColumn("place", F.col("run") + F.coalesce("carried", F.lit(0))).drop("part", "run", "carried")


BLOCK = "g string, block long, digests array<string>, levels int, top string"


def _block(g: str, block: int, digests: list[str], deep: int) -> tuple:
    """One block: its nodes, the levels made of them, and its top.

    The first block of a group is full or the only one, and ends where one node remains. Others are
    never the only one, and go on up to the level of the full ones.
    """
    nodes, levels = sweep(digests, deep)
    if block:
        return g, block, digests, deep, lifted(nodes[0], deep - levels)
    return g, block, digests, levels, nodes[0]


def _made(ended: list[tuple], deep: int) -> pa.RecordBatch:
    """Blocks from their keys and the slices that they came in."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.string()]
    blocks, rows, sizes = [], [], [0]
    for (g, block), slices in ended:
        digests = [d for s in slices for d in s.column("digest").to_pylist()]
        blocks.append(_block(g, block, digests, deep))
        rows += [s.column("row") for s in slices]
        sizes.append(sizes[-1] + len(digests))
    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(rows))
    columns = [pa.array(list(c), t) for c, t in zip(zip(*blocks, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([lists, *columns], names=["rows", *[f.split()[0] for f in BLOCK.split(", ")]])


def _forward(deep: int):
    """Sorted nodes to blocks; at most one block's nodes and as many of small ones are held."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended: list[tuple] = []
        key, held, waiting = None, [], 0
        for batch in batches:
            keys = list(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key:
                    if held:
                        ended.append((key, held))
                    if waiting >= 1 << deep:
                        yield _made(ended, deep)
                        ended, waiting = [], 0
                    key, held = keys[at], []
                held.append(batch.slice(at, end - at))
                waiting += end - at
                at = end
        if held:
            yield _made([*ended, (key, held)], deep)

    return swept


def _backward(deep: int):
    """Blocks with the rest of their tops' proofs to nodes with theirs."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(n)[i].as_py() for n in ("g", "block", "digests", "levels", "siblings", "sides", "subroot", "root")}
                n = len(one["digests"])
                found = proofs(one["digests"], one["levels"])
                columns = [
                    batch.column("rows").slice(i, 1).flatten(),
                    pa.array([one["g"]] * n, pa.string()),
                    pa.array(range(one["block"] << deep, (one["block"] << deep) + n), pa.int64()),
                    pa.array(one["digests"], pa.string()),
                    pa.array([d + one["siblings"] for d, _ in found], pa.list_(pa.string())),
                    pa.array([s + one["sides"] for _, s in found], pa.string()),
                    pa.array([one["subroot"]] * n, pa.string()),
                    pa.array([one["root"]] * n, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "g", "place", "digest", "siblings", "sides", "subroot", "root"])

    return swept


def _rise(nodes: DataFrame, deep: int) -> list[DataFrame]:
    """The blocks of each round, from the leaves up; in the last, every group has one block.

    ``nodes`` has ``row``, ``g``, ``place`` and ``digest``.
    """
    rounds: list[DataFrame] = []
    while True:
        keyed = nodes.select("row", "g", F.shiftright("place", deep).alias("block"), "place", "digest")
        dealt = keyed.repartition("g", "block").sortWithinPartitions("g", "block", "place").drop("place")
        rows = StructField("rows", ArrayType(keyed.schema["row"].dataType))
        blocks = checkpointed(dealt.mapInArrow(_forward(deep), StructType([rows, *StructType.fromDDL(BLOCK).fields])))
        rounds.append(blocks)
        if blocks.filter("block > 0").isEmpty():
            return rounds
        nodes = blocks.select(F.struct("block").alias("row"), "g", F.col("block").alias("place"), F.col("top").alias("digest"))


def _fall(rounds: list[DataFrame], given: DataFrame, deep: int) -> DataFrame:
    """Proofs of the leaves. ``given`` has the rest of the proof of each group's top: ``g``,
    ``siblings``, ``sides``, ``subroot``, ``root``."""
    given = given.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        fields = StructType.fromDDL("g string, place long, digest string, siblings array<string>, sides string, subroot string, root string").fields
        row = blocks.schema["rows"].dataType.elementType
        joined = blocks.join(given, ["g", "block"])
        nodes = joined.mapInArrow(_backward(deep), StructType([StructField("row", row), *fields]))
        given = nodes.select("g", "siblings", "sides", "subroot", "root", F.col("place").alias("block"))
    return nodes


def manifest(docs: DataFrame, columns: list[str], group: str, order: list[str], keep: list[str] | None = None, deep: int = LEVELS) -> DataFrame:
    """A leaf for every row of ``docs``, with its way to the root.

    Columns: ``row`` (the columns in ``keep``; by default those in ``order``), ``digest`` (the leaf's, over ``columns``),
    ``subroot`` (of its ``group``), ``root``, ``siblings`` (digests from the leaf up) and ``sides`` (a letter a level, see ``proofs``).

    NULL is a value like others: a null group comes first, null keys come first, a null column counts as
    ``-``. Rows with one key stand in the order of their leaves; equal rows are leaves of their own. An empty text is
    ``0:``; a very long text only passes the hash. An empty table has no rows. The caller's columns are inside ``row``
    and may have any names. ``deep`` is how many levels a block has; a task holds 2 ** ``deep`` nodes.
    """
    one = docs.select(
        F.struct(*(keep or order)).alias("row"),
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.struct(*order).alias("key"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
    )
    # the last key only spreads equal rows over ranges
    leaves = numbered(one.withColumns({"leaf": F.col("digest"), "tie": F.monotonically_increasing_id()}), ["key", "leaf", "tie"])
    rounds = _rise(leaves, deep)
    tops = rounds[-1].select(F.struct(F.col("g").alias("of"), F.col("top").alias("subroot")).alias("row"), F.lit("").alias("g"), F.col("g").alias("key"), F.col("top").alias("digest"))
    upper = _rise(numbered(tops, ["key"]), deep)
    root = upper[-1].select("g", F.array().cast("array<string>").alias("siblings"), F.lit("").alias("sides"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    subroots = _fall(upper, root, deep).select(F.col("row.of").alias("g"), "siblings", "sides", F.col("row.subroot").alias("subroot"), "root")
    return _fall(rounds, subroots, deep).select("row", "digest", "subroot", "root", "siblings", "sides")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ways = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if w[0] is None else fold(*w) for w in ways], pa.string())], names=["row", "folded_root"])


def folded(proved: DataFrame, leaf: Column, keep: list[str]) -> DataFrame:
    """``row`` (the columns in ``keep``) and ``folded_root``, recomputed from ``leaf`` and each row's
    siblings; NULL for a null leaf. A row is as the manifest says if it equals the root."""
    one = proved.select(F.struct(*keep).alias("row"), leaf.alias("leaf"), "siblings", "sides")
    return one.mapInArrow(_fold, row_and(one, "folded_root string"))
