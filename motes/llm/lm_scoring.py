"""Scores of whole texts under a recurrent language model trained on the corpus itself.

Words are counted over all training documents. Those of a bounded head travel to the tasks;
the counts of the rest meet the texts that hold them in a join, so the vocabulary may grow
without limit. The network knows the most frequent words; any other is the class ``rare``,
within which its count decides. Training runs in rounds over all training documents: every
task learns from its share, and the weights are averaged, by tokens, for the next round.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.llm import gru
from motes.session import checkpointed

# Words whose counts are sent to all tasks (a bound on what is broadcast); the rest is joined.
HEAD_WORDS = 400_000
# Hundredths of the training documents learnt in each round; later rounds start from the
# averaged weights of the earlier ones.
ROUNDS = (6, 24, 70)
# Tokens laid out in lanes at a time, and words counted before they are handed on.
TOKENS_AT_ONCE = 3_000_000
WORDS_AT_ONCE = 300_000
# Average of so many tasks' weights by one task, then one average of those.
AVERAGERS = 32


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``c`` over all texts; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(text_words(value.as_py()))
                found[b""] += 1
                if len(found) >= WORDS_AT_ONCE:
                    yield out(found)
                    found = Counter()
        yield out(found)

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Head:
    """Counts of the most frequent words, and the network's ids of those it knows."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        order = np.lexsort((np.array(words, object), -counts)) if len(words) else np.zeros(0, np.int64)
        self.index = {words[i]: at for at, i in enumerate(order)}
        self.counts = counts[order]
        known = [w for w in (words[i] for i in order) if w][: gru.WORDS - gru.FIRST_WORD]
        self.network = np.full(len(order) + 1, gru.RARE, np.int32)  # the last: not in the head
        for i, w in enumerate(known):
            self.network[self.index[w]] = gru.FIRST_WORD + i
        if b"" in self.index:
            self.network[self.index[b""]] = gru.END

    def places(self, words: list[bytes]) -> np.ndarray:
        get, other = self.index.get, len(self.counts)
        return np.fromiter((get(w, other) for w in words), np.int64, len(words))

    def network_counts(self, total: int) -> np.ndarray:
        out = np.bincount(self.network[:-1], self.counts, gru.WORDS)
        out[gru.RARE] += total - self.counts.sum()
        return out


_HEADS: dict[int, Head] = {}


def _head(shared) -> Head:
    """One dictionary a Python worker, made from the broadcast arrays."""
    if shared._jbroadcast_id not in _HEADS:
        _HEADS.clear()
        words, counts = shared.value
        _HEADS[shared._jbroadcast_id] = Head(words.split(b"\n")[1:], np.frombuffer(counts, np.int64))
    return _HEADS[shared._jbroadcast_id]


class Shared:
    """A broadcast with an id that survives pickling."""

    def __init__(self, spark, value):
        self._broadcast = spark.sparkContext.broadcast(value)
        self._jbroadcast_id = self._broadcast._jbroadcast.id()

    def __getstate__(self):
        return self._broadcast, self._jbroadcast_id

    def __setstate__(self, state):
        self._broadcast, self._jbroadcast_id = state

    @property
    def value(self):
        return self._broadcast.value


def _laid_out(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows in groups of a bounded number of tokens: the other columns' cells, and the words."""
    rows, words, size = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            found = text_words(batch.column(column)[i].as_py())
            found.append(b"")
            rows.append(tuple(batch.column(j)[i].as_py() for j in range(batch.num_columns) if j != column))
            words.append(found)
            size += len(found)
            if size >= TOKENS_AT_ONCE:
                yield rows, words
                rows, words, size = [], [], 0
    if rows:
        yield rows, words


def trained(texts: DataFrame, turn: Column, head: Shared, total: int) -> bytes:
    """Weights after all rounds; ``turn`` (0 to 99) says in which round a text is learnt."""
    weights = gru.initial(_head(head).network_counts(total)).packed()

    def learner(start: bytes):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _head(head)
            trainer = gru.Trainer(gru.unpacked(start))
            group, size = [], 0
            for batch in batches:
                for value in batch.column(0):
                    ids = known.network[known.places([*text_words(value.as_py()), b""])]
                    group.append(ids)
                    size += len(ids)
                    if size >= TOKENS_AT_ONCE // 4:
                        trainer.train(group)
                        group, size = [], 0
            if group:
                trainer.train(group)
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.weights.packed()], pa.binary()), pa.array([trainer.tokens], pa.int64())], names=["weights", "tokens"])

        return learn

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for data, n in zip(batch.column(0), batch.column(1)):
                part = np.frombuffer(data.as_py(), "<f4").astype(np.float64) * n.as_py()
                total = part if total is None else total + part
                tokens += n.as_py()
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["weights", "tokens"])

    kind, below = "weights binary, tokens long", 0
    for share in ROUNDS:
        part = texts.filter((turn >= below) & (turn < below + share))
        below += share
        some = part.mapInArrow(learner(weights), kind).repartition(AVERAGERS).mapInArrow(average, kind)
        found = some.coalesce(1).mapInArrow(average, kind).collect()
        if found:
            weights = bytes(found[0]["weights"])
    return weights


def lm_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Scores are log10. A text is its lower-cased words and an end; of null and empty texts the
    end alone. Rows for which ``held_out`` is null are learnt from. Repeated rows and copies
    score alike. Without training rows all words are unknown and the network keeps its
    first weights. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("binary").alias("t")
    held = F.coalesce(held_out, F.lit(False))
    learnt = docs.filter(~held)
    counts = checkpointed(word_counts(learnt.select(body)))
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    # the head is all words above a count, so that no more than HEAD_WORDS are collected
    least = 0
    if v > HEAD_WORDS:
        seen = 0
        for row in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
            seen += row["count"]
            if seen > HEAD_WORDS:
                least = row["c"]
                break
    top = counts.filter(F.col("c") > least).toArrow()
    words = top["word"].to_pylist()
    head = Shared(spark, (b"\n" + b"\n".join(words) if words else b"", top["c"].to_numpy().astype(np.int64).tobytes()))
    known = _head(head)
    turn = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(100))
    weights = trained(learnt.select(body, turn.alias("turn")), F.col("turn"), head, n)
    # words outside the network: how many, and how many different ones
    network = known.network[:-1]
    n_rare = n - int(known.counts[network != gru.RARE].sum())
    v_rare = v - int((network != gru.RARE).sum())
    below = math.log10(n + v + 1)
    below_rare = math.log10(n_rare + v_rare + 1)

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))]
    names = ["id", "held_out", "digest", "n_tokens", "n_known", "base", "score", "others"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores by the head's counts, and the words that are not in it with their frequency."""
        known = _head(head)
        model = gru.unpacked(weights)
        log_count = np.append(np.log10(known.counts + 1.0), 0.0)  # the last: not in the head
        rare = known.network == gru.RARE
        outside = len(known.counts)
        for rows, texts in _laid_out(batches, 3):
            places = [known.places(w) for w in texts]
            value = gru.scores(model, [known.network[p] for p in places]) / math.log(10)
            out = []
            for row, words, p, s in zip(rows, texts, places, value):
                other = np.flatnonzero(p == outside)
                found = Counter(words[i] for i in other)
                unknown = rare[p]
                out.append((
                    *row,
                    len(p),
                    len(p) - len(other),
                    float(log_count[p].sum()) - len(p) * below,
                    float(s + log_count[p[unknown]].sum() - unknown.sum() * below_rare),
                    [{"word": w, "times": n} for w, n in found.items()],
                ))
            for lo in range(0, len(out), 4096):
                part = out[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in part], kind) for i, kind in enumerate(kinds)], names=names)

    digest = F.xxhash64(F.col(text)).alias("digest")
    ident = F.col(key).cast("long").alias("id")
    columns = "id long, held_out boolean, digest long, n_tokens long, n_known long, base double, score double, others array<struct<word:binary,times:long>>"
    # read twice below, so the network runs once
    scored = checkpointed(docs.select(ident, held.alias("held_out"), digest, body).mapInArrow(score, columns))
    rest = scored.select("id", "digest", F.inline("others"))
    # rows that are equal are counted, so that their other words are added once to each
    # (the network's last digits depend on the texts beside it; one value stands for all)
    scored = scored.groupBy("id", "held_out", "digest", "n_tokens", "n_known").agg(
        F.max("base").alias("base"), F.max("score").alias("score"), F.count(F.lit(1)).alias("rows")
    )
    met = rest.join(counts.filter(F.col("c") <= least), "word")
    added = met.groupBy(F.struct("id", "digest").alias("at")).agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("gain")
    )
    both = scored.withColumn("at", F.struct("id", "digest")).join(added, "at", "left")
    gain = F.coalesce(F.col("gain") / F.col("rows"), F.lit(0.0))
    return both.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("more") / F.col("rows")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")
