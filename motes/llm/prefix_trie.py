"""Prefix trie of conversations by truncation peeling.

Each turn is a digest, and each prefix of a conversation the digest of the prefix before it and its last
turn, so equal prefixes are equal digests and a prefix is cut by dropping its last. Equal conversations are
one row from the start.

From the deepest turn that two different conversations share, one round a depth: conversations that end
here join the nodes that survived from below, one grouping finds the nodes of this depth and adds up what
their subtrees hold, and the last turn of each is stripped. The grouping combines before it
shuffles, so an opening that a third of all conversations share costs a row a task. A
conversation that is alone from some turn on is a chain from there to its end; the
rounds start where it is still alone for the last time, and the chain's nodes follow from its sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.llm.common import n_words
from motes.session import checkpointed

ROOT = bytes(32)
# Ids of one piece of a node's list, and turns of one batch of paths.
PIECE = 4096
BATCH_TURNS = 100_000


def turn_digests(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``place`` (from 0, null order first, ties by the turn's digest), ``said`` (digest of role
    and text, null as empty) and ``words`` of every turn. Rows without an id belong to no conversation.

    Texts are digested where they lie; only digests are shuffled.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    one = turns.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv_id"),
        F.col(order).alias("at"),
        F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256).alias("said"),
        n_words(t).alias("words"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "said")) - 1
    return one.select("conv_id", place.cast("long").alias("place"), "said", "words")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to conversations: digests of all prefixes, the empty one first, and words up to each."""
    kind = pa.int64()
    ids, paths, totals = [], [], []
    turns = 0

    def made() -> pa.RecordBatch:
        columns = [pa.array(ids, kind), pa.array(paths, pa.list_(pa.binary())), pa.array(totals, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "path", "totals"])

    for batch in batches:
        for c, place, said, words in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "place", "said", "words")], strict=True):
            if not ids or ids[-1] != c:
                if turns >= BATCH_TURNS:
                    yield made()
                    ids, paths, totals, turns = [], [], [], 0
                ids.append(c)
                paths.append([ROOT])
                totals.append([0])
                turns += 1
            if place >= 0:
                paths[-1].append(sha256(paths[-1][-1] + said.encode()).digest())
                totals[-1].append(totals[-1][-1] + words)
                turns += 1
    if ids:
        yield made()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node to texts of bounded length."""
    key, ids = None, []
    for batch in batches:
        rows: list[tuple] = []
        for node, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (node != key or len(ids) == PIECE):
                rows.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = node
            ids.append(c)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest a node; a piece at a time."""
    key, state = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        rows = []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == key:
                state.update(b",")
            else:
                if state is not None:
                    rows.append((key, state.hexdigest()))
                key, state = node, sha256()
            state.update(text.encode())
        yield made(rows)
    if state is not None:
        yield made([(key, state.hexdigest())])


def _ends(paths: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256``: the ids of the conversations that end there, ascending.

    A digest of a list is made from its front to its end; the list is brought together in pieces, so
    that a node where a third of all conversations end is one task's stream of few rows.
    """
    ended = paths.select(F.element_at("path", -1).alias("node"), "conv_id")
    pieces = ended.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def _at(column: str, place: Column) -> Column:
    return F.element_at(column, place.cast("int") + 1)


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth from what ends here and what survived from below."""
    grouped = rows.groupBy(_at("path", F.lit(depth)).alias("node")).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.any_value("path").alias("path"),
        F.any_value("totals").alias("totals"),
    )
    own = _at("totals", F.lit(depth)) - _at("totals", F.lit(depth - 1)) if depth else F.lit(0)
    return grouped.withColumns(
        {
            "n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * own,
        }
    )


SUMS = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie: ``node`` (digest of the prefix), ``depth``, ``conv_id`` (smallest member),
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``conv_id`` (integers), ``place`` (unique in a conversation), ``said`` and ``words``, as ``turn_digests``
    gives them; other columns are ignored. ``conversations`` may name further ``conv_id``, such as those without turns, which
    end at the root. Equal conversations are members of one end. A conversation is a
    sequence and streams through one task as digests; texts do not. Without conversations there is no node.
    The rounds are as many as the deepest turn that two different conversations share.
    """
    named = turns.select("conv_id") if conversations is None else turns.select("conv_id").union(conversations.select("conv_id"))
    known = named.filter("conv_id IS NOT NULL").distinct().select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("said"), F.lit(0).cast("long").alias("words"))
    sorted_turns = turns.select("conv_id", "place", "said", "words").union(known).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    paths = checkpointed(sorted_turns.mapInArrow(_paths, "conv_id long, path array<binary>, totals array<long>"))

    copies = paths.groupBy(F.element_at("path", -1).alias("end")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.any_value("path").alias("path"), F.any_value("totals").alias("totals")
    )
    distinct = checkpointed(copies.withColumn("n", F.size("path") - 1))
    prefixes = distinct.select("end", F.posexplode("path").alias("depth", "node"))
    lone = prefixes.groupBy("node").agg(F.count(F.lit(1)).alias("sharing"), F.min("end").alias("end"), F.min("depth").alias("depth"))
    alone_from = lone.filter("sharing = 1").groupBy("end").agg(F.min("depth").alias("depth"))
    cut = distinct.join(alone_from, "end", "left").withColumn("depth", F.coalesce("depth", "n"))
    chained = (F.col("depth") < F.col("n")).cast("long")
    entering = checkpointed(
        cut.select(
            "conv_id", "n_convs", "n", "path", "totals", "depth", chained.alias("n_children"), chained.alias("n_leaves"),
            ((F.col("n_convs") - 1) * (F.element_at("totals", -1) - _at("totals", F.col("depth")))).alias("saved_tokens"),
        )
    )

    below = entering.filter(chained == 1).select("*", F.explode(F.sequence(F.col("depth") + 1, F.col("n"))).alias("d"))
    chain = below.select(
        _at("path", F.col("d")).alias("node"), F.col("d").cast("long").alias("depth"), "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs",
        (F.col("d") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.element_at("totals", -1) - _at("totals", F.col("d") - 1))).alias("saved_tokens"),
    )

    deepest = entering.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = entering.filter(F.col("depth") == depth).select("path", "totals", *SUMS)
        if levels:
            stripped = [F.slice(c, 1, depth + 1).alias(c) for c in ("path", "totals")]
            survived = levels[-1].select(*stripped, "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
            rows = rows.union(survived)
        levels.append(checkpointed(_level(rows, depth)))

    nodes = chain
    if levels:
        with_depth = [x.select("node", F.lit(len(levels) - 1 - i).cast("long").alias("depth"), _at("path", F.lit(len(levels) - 2 - i)).alias("parent") if i < len(levels) - 1 else F.lit(None).cast("binary").alias("parent"), *SUMS) for i, x in enumerate(levels)]
        peeled = with_depth[0]
        for x in with_depth[1:]:
            peeled = peeled.union(x)
        parents = peeled.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        nodes = chain.unionByName(peeled.join(parents, "parent", "left").drop("parent"))
    none = F.lit(sha256().hexdigest())
    return nodes.join(_ends(paths), "node", "left").select(
        "node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
