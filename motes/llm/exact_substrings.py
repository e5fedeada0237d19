"""Removal of long repeated byte strings, by sorting suffixes bucket by bucket.

Every string of 400 bytes has an anchor: the place of the smallest hash among its 128-byte
grams. Equal strings have equal anchors at equal places, so the corpus splits into buckets
of suffixes by anchor, and an anchor that occurs once settles the strings around it. A
unit is a run of string starts with one anchor, with the bytes that they cover; equal units
are counted once. The units of a few buckets at a time form a block, and their
suffixes are sorted there: by their first 16 bytes, and where those tie by the ranks of a
difference-cover sample of the block, precomputed by doubling, then by the last 16 bytes.
Only suffixes that tie with a neighbour go on, and memory is bounded by the block.

On request passages of some number of words that several rows share are found too, however
few bytes they have: anchors are then the smallest hash among grams of words, units that
recur as a whole are settled, and only the windows of units that differ around one anchor
are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.session import checkpointed, scratch_path

SPAN = 400
GRAM = 128
# Grams in a string, and string starts that are looked at in one go.
INSIDE = SPAN - GRAM + 1
CHUNK = 1 << 20
# Fixed value: residues mod 16 of which any two differ by each of 0 .. 15.
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
# The sample ranks reach so far; the last PERIOD bytes are compared by themselves.
DEEP = SPAN - PERIOD
# Words of a gram where passages are told by words.
GRAM_WORDS = 8
# Distinct units of one bucket beyond which its strings are counted by digests instead, and
# the bytes of a block.
MOST_UNITS = 4000
BLOCK = 4 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 22) - 1)
_ALL = (1 << 64) - 1
_Q = 0xD6E8FEB86659FD93
_Q_INVERSE = pow(_Q, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(CHUNK + SPAN, int(_P))
_DOWN = _powers(CHUNK + SPAN, pow(int(_P), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _lowest(h: np.ndarray, inside: int) -> np.ndarray:
    """The place of the smallest hash in each run of ``inside`` hashes."""
    # the place breaks ties, so the first of equal grams in a string is its anchor
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    grid = np.full(-(-len(h) // inside) * inside, ~np.uint64(0))
    grid[: len(h)] = key
    grid = grid.reshape(-1, inside)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(h) - inside + 1
    return (np.minimum(back[:starts], ahead[inside - 1 : inside - 1 + starts]) & _PLACE).astype(np.int64)


def anchors(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit: the anchor's hash, its place, the first start and the number of starts."""
    parts = []
    for lo in range(0, len(body) - SPAN + 1, CHUNK):
        b = np.frombuffer(body, np.uint8, min(CHUNK + SPAN - 1, len(body) - lo), lo).astype(np.uint64)
        n = len(b)
        total = np.r_[np.uint64(0), np.cumsum((b + np.uint64(1)) * _DOWN[:n], dtype=np.uint64)]
        grams = n - GRAM + 1
        h = _mixed((total[GRAM:] - total[:grams]) * _UP[:grams])
        at = _lowest(h, INSIDE)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        parts.append((h[at[first]], at[first] + lo, first + lo, np.diff(np.r_[first, len(at)])))
    return _gathered(parts)


def _gathered(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    if not parts:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def word_edges(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in bytes."""
    b = np.frombuffer(body, np.uint8)
    inside = np.r_[False, (b != 32) & ((b < 9) | (b > 13)), False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_units(bodies: list[bytes], words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each unit of windows of so many words: the text, the anchor's hash, the first window
    and the number of windows, and the hashes of all windows one unit after the other.

    Short texts are taken together, so that arrays are not tiny; a text's units don't depend
    on its company.
    """
    lo = 0
    while lo < len(bodies):
        hi, size = lo + 1, len(bodies[lo]) + 1
        while hi < len(bodies) and size + len(bodies[hi]) < CHUNK:
            size += len(bodies[hi]) + 1
            hi += 1
        body = b"\n".join(bodies[lo:hi])
        sizes = np.array([len(b) + 1 for b in bodies[lo:hi]])
        begin, end = word_edges(body)
        owner = np.searchsorted(np.cumsum(sizes), begin, "right")
        for h, first, n, windows in _units_in(body, words, begin, end, owner):
            d = owner[first]
            yield d + lo, h, first - np.searchsorted(owner, d), n, windows
        lo = hi


def _units_in(body: bytes, words: int, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    gram = min(GRAM_WORDS, words)
    lo, last = 0, len(begin) - words + 1
    while lo < last:
        # windows that lie in a stretch of CHUNK bytes, one at least
        hi = min(last, max(lo + 1, int(np.searchsorted(end, begin[lo] + CHUNK, "right")) - words + 1))
        s, e = begin[lo : hi + words - 1] - begin[lo], end[lo : hi + words - 1] - begin[lo]
        b = np.frombuffer(body, np.uint8, int(e[-1]), int(begin[lo])).astype(np.uint64)
        n = len(b)
        up, down = (_UP, _DOWN) if n <= len(_UP) else (_powers(n, int(_P)), _powers(n, pow(int(_P), -1, 1 << 64)))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * down[:n], out=total[1:])
        # a word, and the word with the bytes up to the next one
        alone = _mixed(_mixed((total[e] - total[s]) * up[s]))
        on = _mixed(_mixed((total[s[1:]] - total[s[:-1]]) * up[s[:-1]]))
        sums = np.zeros(len(s), np.uint64)
        np.cumsum(on * _powers(len(s), _Q_INVERSE)[1:], out=sums[1:])

        def strings(k: int) -> np.ndarray:
            """Hashes of all k words in a row, with the bytes between them."""
            at = len(s) - k + 1
            return _mixed((sums[k - 1 :] - sums[:at]) * _powers(at, _Q) + alone[k - 1 :] * np.uint64(pow(_Q, k - 1, 1 << 64) * 3 & _ALL))

        h = strings(gram)
        at = _lowest(h, words - gram + 1)
        windows = strings(words)
        same = owner[lo:hi] == owner[lo + words - 1 : hi + words - 1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (same[1:] != same[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        inside = same[first]
        yield h[at[first[inside]]], first[inside] + lo, count[inside], windows[same]
        lo = hi


def _words_at(block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes from each place on, as two numbers that sort like them."""
    view = np.ndarray((len(block) - 7,), ">u8", block, 0, (1,))
    return view[at].astype(np.uint64), view[at + 8].astype(np.uint64)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys (the first is the most significant); equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank


def sample_ranks(block: np.ndarray, places: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Ranks of the sampled suffixes by their first DEEP bytes (-1: fewer bytes are left).

    ``places``: the sample, ascending; ``room``: bytes left in the unit. The rank of twice
    the depth is that of two ranks half as deep; the place a multiple of the period further
    is in the sample too.
    """
    index = np.full(len(block) + 1, -1, np.int32)
    index[places] = np.arange(len(places), dtype=np.int32)
    live = np.flatnonzero(room >= PERIOD)
    by_depth: dict[int, np.ndarray] = {}
    depth = PERIOD
    rank = np.full(len(places), -1, np.int32)
    rank[live] = _dense(*_words_at(block, places[live]))
    by_depth[depth] = rank
    while depth * 2 <= DEEP:
        rank = _joined(by_depth[depth], by_depth[depth], depth, depth * 2, places, room, index)
        depth *= 2
        by_depth[depth] = rank
    done = depth
    for half in sorted(by_depth, reverse=True):
        while done + half <= DEEP:
            rank = _joined(rank, by_depth[half], done, done + half, places, room, index)
            done += half
    return rank


def _joined(front, tail, depth, reach, places, room, index) -> np.ndarray:
    live = np.flatnonzero(room >= reach)
    out = np.full(len(places), -1, np.int32)
    if len(live):
        out[live] = _dense(front[live], tail[index[places[live] + depth]])
    return out


def repeated_starts(units: list[tuple[int, bytes, int, int]]) -> list[np.ndarray]:
    """For units (bucket, bytes, place of the anchor, copies): which starts recur.

    All units of a bucket are given. A unit with several copies recurs as a whole. Places in
    a block fit 32 bits: it has BLOCK bytes, and those of one bucket of MOST_UNITS, at most.
    """
    sizes = np.array([len(u[1]) for u in units])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    block = np.frombuffer(b"".join(u[1] for u in units) + bytes(8), np.uint8)
    counts = sizes - SPAN + 1
    owner = np.repeat(np.arange(len(units), dtype=np.int32), counts)
    # places count from the anchor: equal strings lie alike in the period
    shift = np.array([(-u[2]) % PERIOD for u in units])
    residue = np.repeat(((shift - begin) % PERIOD).astype(np.uint8), sizes)
    residue += (np.arange(sizes.sum(), dtype=np.int32) % PERIOD).astype(np.uint8)
    residue %= PERIOD
    sampled = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[residue]).astype(np.int32)
    room = np.repeat((begin + sizes).astype(np.int32), sizes)[sampled] - sampled
    at_sample = np.full(len(block), -1, np.int32)
    at_sample[sampled] = sample_ranks(block, sampled, room)
    to_cover = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)], np.int32)
    del sampled, room

    bucket = np.array([u[0] for u in units], np.int64)
    place = np.repeat((begin - np.cumsum(counts) + counts).astype(np.int32), counts)
    place += np.arange(len(place), dtype=np.int32)
    # sort by bucket and first bytes; only ties go on
    live = np.arange(len(place))
    group = _dense(bucket[owner], *_words_at(block, place))
    keys = (
        lambda i: (residue[place[i]], at_sample[place[i] + to_cover[residue[place[i]]]]),
        lambda i: _words_at(block, place[i] + DEEP),
    )
    tie = group
    for key in (None, *keys):
        if key is not None:
            tie = _dense(tie, *key(live))
        often = np.bincount(tie) > 1
        keep = often[tie]
        live, tie = live[keep], tie[keep]
    again = np.zeros(len(place), bool)
    again[live] = True
    whole = np.array([u[3] > 1 for u in units])
    again |= whole[owner]
    ends = np.cumsum(counts)
    return [again[e - c : e] for e, c in zip(ends, counts)]


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_RUN = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _unit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, texts, lows = [], [], []
        for i in range(batch.num_rows):
            h, _, lo, n = anchors(batch.column(1)[i].as_py() or b"")
            hashes.append(h)
            texts.append(np.full(len(h), i))
            lows.append(lo)
        if hashes:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hashes).view(np.int64)),
                    batch.column(0).take(pa.array(np.concatenate(texts).astype(np.int64))),
                    pa.array(np.concatenate(lows).astype(np.int64)),
                ],
                names=["anchor", "d", "lo"],
            )


_WORDS = "anchor long, d binary, row long, lo long, n long, head long, tail long"


def _word_anchors(words: int):
    """Units of words of every row, with the hashes of their first and last window."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for d, h, lo, n, windows in word_units(part.column(1).to_pylist(), words):
                    last = np.cumsum(n) - 1
                    columns = [h.view(np.int64), lo, n, windows[last - n + 1].view(np.int64), windows[last].view(np.int64)]
                    anchor, lo, n, head, tail = (pa.array(c) for c in columns)
                    d = pa.array(d)
                    yield pa.RecordBatch.from_arrays([anchor, part.column(0).take(d), part.column(2).take(d), lo, n, head, tail], names=[x.split()[0] for x in _WORDS.split(", ")])

    return found


def _cut_units(words: int | None):
    """Units of the texts whose anchors recur; their bytes once in a batch.

    Units of words: the hashes of their windows; start and whole as in ``_word_start``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            rows = []
            asked = [set(w) for w in batch.column(3).to_pylist()]
            for d, body, copies, wanted in zip(*[c.to_pylist() for c in batch.columns[:3]], asked):
                if max(wanted) < 0:
                    continue
                h, place, lo, n = anchors(body)
                for k in range(len(h)):
                    s = int(lo[k])
                    if s in wanted:
                        bytes_ = body[s : s + int(n[k]) - 1 + SPAN]
                        name = hashlib.blake2b(bytes_ + int(place[k] - s).to_bytes(4, "little"), digest_size=16).digest()
                        rows.append((int(h[k].view(np.int64)), name, d, s, int(n[k]), int(place[k]) - s, copies, None if name in seen else bytes_, None))
                        seen.add(name)
                        if len(rows) >= 8192:
                            yield _unit_batch(rows)
                            rows = []
            yield _unit_batch(rows)
            some = [i for i, wanted in enumerate(asked) if min(wanted) < 0]
            if words and some:
                yield from _unit_windows(batch, some, asked, words)

    return cut


def _unit_windows(batch: pa.RecordBatch, some: list[int], asked: list[set[int]], words: int) -> Iterator[pa.RecordBatch]:
    ids = [batch.column(0)[i].as_py() for i in some]
    rows = []
    for d, h, lo, n, windows in word_units([batch.column(1)[i].as_py() for i in some], words):
        edge = np.cumsum(n).tolist()
        for k, (i, s, m) in enumerate(zip(d.tolist(), lo.tolist(), n.tolist())):
            for start in {-1 - 2 * s, -2 - 2 * s} & asked[some[i]]:
                rows.append((int(h[k].view(np.int64)), None, ids[i], start, m, None, None, None, windows[edge[k] - m : edge[k]].view(np.int64)))
        if len(rows) >= 8192:
            yield _unit_batch(rows)
            rows = []
    yield _unit_batch(rows)


_UNIT = "anchor long, unit binary, d binary, lo long, n long, at long, copies long, bytes binary, windows array<long>"


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _UNIT.split(", ")])


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, one after the other, gathered to blocks of bounded size."""
    block: list[tuple] = []
    size = 0

    def sorted_block(rows: list[tuple]) -> pa.RecordBatch:
        marks = repeated_starts([(a, body, at, copies) for a, _, body, at, copies in rows])
        found = [(r[0], r[1], runs(m)) for r, m in zip(rows, marks) if m.any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([[{"lo": a, "hi": b} for a, b in f[2]] for f in found], _RUN)],
            names=["anchor", "unit", "runs"],
        )

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if block and size >= BLOCK and row[0] != block[-1][0]:
                yield sorted_block(block)
                block, size = [], 0
            block.append(row)
            size += len(row[2])
    if block:
        yield sorted_block(block)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for anchor, unit, body, _, copies in zip(*[c.to_pylist() for c in batch.columns]):
            n = len(body) - SPAN + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([anchor] * n, pa.int64()),
                    pa.array([unit] * n, pa.binary()),
                    pa.array(range(n), pa.int64()),
                    pa.array([copies] * n, pa.int64()),
                    pa.array([hashlib.blake2b(body[i : i + SPAN], digest_size=16).digest() for i in range(n)], pa.binary()),
                ],
                names=["anchor", "unit", "i", "copies", "string"],
            )


def _crowded(units: DataFrame) -> DataFrame:
    """The same for buckets of very many units: their strings are counted by digest, spread over the cluster."""
    strings = checkpointed(units.mapInArrow(_digests, "anchor long, unit binary, i long, copies long, string binary"))
    again = strings.groupBy("string").agg(F.sum("copies").alias("n")).filter("n > 1").select("string")
    hit = strings.join(again, "string").select("anchor", "unit", F.struct(F.col("i").alias("lo"), (F.col("i") + 1).alias("hi")).alias("run"))
    return hit.groupBy("anchor", "unit").agg(F.collect_list("run").alias("runs"))


def _word_start(first: Column, whole: Column) -> Column:
    """Starts of units of words are below 0, and tell whether the unit recurs as a whole."""
    return -1 - (2 * first + whole.cast("long"))


def _word_places(texts: DataFrame, words: int) -> DataFrame:
    """Places of units of words whose anchors recur in other rows; ``whole``: the unit does;
    ``asked``: its windows must be looked at."""
    rows = texts.withColumn("row", F.monotonically_increasing_id()).select("d", "body", "row")
    found = rows.mapInArrow(_word_anchors(words), _WORDS).repartition("anchor")
    unit, bucket = Window.partitionBy("anchor", "n", "head", "tail"), Window.partitionBy("anchor")
    found = found.withColumns({"low": F.min("row").over(unit), "high": F.max("row").over(unit)}).withColumn("whole", F.col("low") != F.col("high"))
    spread = (F.min("row").over(bucket) != F.max("row").over(bucket)).alias("spread")
    found = found.select("anchor", "d", "lo", "n", "whole", (F.col("row") == F.col("low")).alias("one"), spread, F.min("whole").over(bucket).alias("settled"))
    found = found.filter("spread AND (whole OR NOT settled)")
    return checkpointed(found.select("anchor", "d", "lo", "n", "whole", F.expr("one AND NOT settled").alias("asked")))


def _shared_words(places: DataFrame, units: DataFrame, words: int) -> DataFrame:
    """``d`` and ``shared``: words in passages of so many words that another row has too."""
    units = units.select("anchor", "d", (-1 - F.col("lo")).alias("at"), "windows")
    units = units.select("anchor", "d", F.floor(F.col("at") / 2).alias("lo"), (F.col("at") % 2 == 1).alias("whole"), "windows")
    crowd = units.groupBy("anchor").agg(F.count(F.lit(1)).alias("units")).filter(F.col("units") > MOST_UNITS).select("anchor")
    crowd = checkpointed(crowd)
    same = Window.partitionBy("anchor", "window")

    def hits(rows: DataFrame) -> DataFrame:
        each = rows.select("anchor", "d", F.xxhash64("d").alias("text"), "lo", "whole", F.posexplode("windows").alias("i", "window"))
        each = each.withColumn("spread", F.max("whole").over(same) | (F.min("text").over(same) != F.max("text").over(same)))
        each = each.filter("spread AND NOT whole")
        return each.select("d", (F.col("lo") + F.col("i")).alias("lo"), (F.col("lo") + F.col("i") + words).alias("hi"))

    # the windows of an anchor meet in one task, unless there are very many
    hit = hits(units.join(crowd, "anchor", "left_anti").repartition("anchor"))
    if not crowd.isEmpty():
        hit = hit.union(hits(units.join(crowd, "anchor")))
    whole = places.filter("whole").select("d", "lo", (F.col("lo") + F.col("n") + (words - 1)).alias("hi"))
    zero = F.lit(0).cast("long")
    spans = whole.union(hit).groupBy("d").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    counted = F.aggregate(
        "spans",
        F.struct(zero.alias("n"), zero.alias("edge")),
        lambda a, x: F.struct((a["n"] + F.greatest(zero, x["hi"] - F.greatest(x["lo"], a["edge"]))).alias("n"), F.greatest(a["edge"], x["hi"]).alias("edge")),
        lambda a: a["n"],
    )
    return checkpointed(spans.select("d", counted.alias("shared")))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, body, spans in zip(*[c.to_pylist() for c in batch.columns]):
            cut = _merged(spans)
            at, kept = 0, []
            for lo, hi in cut:
                kept.append(body[at:lo])
                at = hi
            kept.append(body[at:])
            rows.append((d, len(body) - sum(map(len, kept)), [{"lo": a, "hi": b} for a, b in cut], hashlib.sha256(b"".join(kept)).hexdigest()))
        kinds = [pa.binary(), pa.int64(), _RUN, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["d", "removed", "spans", "sha"])


def repeated_spans(docs: DataFrame, text: str = "text", words: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Distinct texts (``d``: digest, ``body``) and, per ``d``, the ``spans`` that strings found
    elsewhere cover (start and end in bytes, not merged yet). With ``words``, also per ``d``
    the words ``shared`` with other rows in passages of so many words."""
    spark = docs.sparkSession
    texts = docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("d"), F.col(text).cast("binary").alias("body"))
    places = _word_places(texts.filter(F.octet_length("body") >= 2 * words - 1), words) if words else None
    texts = texts.filter(F.octet_length("body") >= (min(SPAN, 2 * words - 1) if words else SPAN))
    found = texts.mapInArrow(_unit_anchors, "anchor long, d binary, lo long")
    # kept apart from its aggregation, so that a very common anchor is split in the join
    often = checkpointed(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor"))
    wanted = found.join(often, "anchor").select("d", "lo")
    if words:
        wanted = wanted.union(places.filter("asked").select("d", _word_start(F.col("lo"), F.col("whole"))))
    wanted = wanted.groupBy("d").agg(F.collect_set("lo").alias("wanted"))
    single = texts.groupBy("d").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    cut = single.join(wanted, "d").select("d", "body", "copies", "wanted").mapInArrow(_cut_units(words), _UNIT)
    path = scratch_path(spark, "units")
    cut.write.option("compression", "zstd").parquet(path)
    every = spark.read.schema(_UNIT).parquet(path)
    units = every.filter("lo >= 0")

    starts = units.select("anchor", "unit", "d", "lo", "n")
    counted = units.groupBy("anchor", "unit").agg(F.sum("copies").alias("copies"), F.first("n").alias("n"), F.first("at").alias("at"))
    crowd = checkpointed(counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("units"), F.sum("copies").alias("all")).filter("all > 1"))
    counted = checkpointed(counted.join(crowd, "anchor"))
    alone = counted.filter("units = 1").select("anchor", "unit", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))).alias("runs"))
    some = units.filter("bytes IS NOT NULL").select("anchor", "unit", "bytes").join(
        counted.filter("units > 1").select("anchor", "unit", "at", "copies", "units"), ["anchor", "unit"]
    )
    some = some.dropDuplicates(["anchor", "unit"]).select("anchor", "unit", "bytes", "at", "copies", "units")
    few = some.filter(F.col("units") <= MOST_UNITS).drop("units").repartition("anchor").sortWithinPartitions("anchor")
    schema = "anchor long, unit binary, runs array<struct<lo:long,hi:long>>"
    result = alone.union(few.mapInArrow(_sort_blocks, schema))
    crowded = counted.filter(F.col("units") > MOST_UNITS)
    if not crowded.isEmpty():
        result = result.union(_crowded(some.filter(F.col("units") > MOST_UNITS).drop("units")))
    run = starts.join(result, ["anchor", "unit"]).select("d", "lo", F.explode("runs").alias("run"))
    spans = run.select("d", F.struct((F.col("lo") + F.col("run.lo")).alias("lo"), (F.col("lo") + F.col("run.hi") + (SPAN - 1)).alias("hi")).alias("span"))
    spans = checkpointed(spans.groupBy("d").agg(F.collect_set("span").alias("spans")))
    shared = _shared_words(places, every.filter("lo < 0"), words) if words else None
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files, True)
    return single.select("d", "body"), spans, shared


def without_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int | None = None) -> DataFrame:
    """``row``, ``n_bytes``, ``n_removed``, the merged ``spans`` and ``kept_sha256`` of every row.

    With ``words``, also ``n_shared_words``: the words that lie in passages of so many words
    (bytes between them included) which another row has too. They are reported, not removed.

    Null and empty texts have 0 bytes and the digest of nothing. Texts below 400 bytes lose
    nothing. Of copies and repeated rows every byte recurs, so all is removed from each.
    """
    texts, spans, shared = repeated_spans(docs, text, words)
    cut = texts.join(spans, "d").select("d", "body", "spans").mapInArrow(_without, "d binary, removed long, spans array<struct<lo:long,hi:long>>, sha string")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.struct(*(keep or docs.columns)).alias("row"),
        F.unhex(F.md5(F.col(text).cast("binary"))).alias("d"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body, 256).alias("whole"),
    )
    rows = rows.join(cut, "d", "left")
    if shared is not None:
        rows = rows.join(shared, "d", "left")
    return rows.select(
        "row",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<lo:long,hi:long>>")).alias("spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
        *([] if shared is None else [F.coalesce("shared", F.lit(0)).cast("long").alias("n_shared_words")]),
    )
