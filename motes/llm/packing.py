"""Packing along a space-filling curve: neighbours on a Hilbert curve share sequences.

A document becomes a hashed vector of byte 4-grams, projected to a few dimensions; the
cell of the projection has a place on the Hilbert curve. Documents are range-sorted by that
place and cut into sequences of 4096 tokens one after the other. Cuts depend only on the
tokens before them in the same range, so each range is packed where it lies; what is left at
its end is cut into sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import row_and

LENGTH = 4096
END_ID = 2
DIMENSIONS = 4
BITS = 15
BUCKETS = 1024
# Words whose ids a Python worker remembers; the memory is emptied when it is full.
REMEMBERED = 700_000

_MARKS = string.punctuation.encode()


def projection(seed: int = 7) -> np.ndarray:
    """Random directions, one column a dimension, of length 1."""
    p = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    return p / np.linalg.norm(p, axis=0)


def coordinates(texts: list[bytes], directions: np.ndarray) -> np.ndarray:
    """Projected, damped and normalised counts of hashed byte 4-grams, one row a text."""
    out = np.zeros((len(texts), BUCKETS))
    for i, t in enumerate(texts):
        if len(t) >= 4:
            gram = np.ndarray((len(t) - 3,), "<u4", t, 0, (1,))  # four bytes from each place on
            out[i] = np.bincount((gram * np.uint32(2654435761)) >> 22, minlength=BUCKETS)
        elif t:
            out[i, zlib.crc32(t) % BUCKETS] = 1
    out = np.sqrt(out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)) @ directions


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (one row each), ``bits`` per dimension.

    From the highest bit down, each level's orientation is undone for the bits below it;
    the Gray code of the interleaved bits is the place.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_places(texts: list[bytes], directions: np.ndarray) -> np.ndarray:
    side = 1 << BITS
    cells = np.clip(((coordinates(texts, directions) + 1) / 2 * side).astype(np.int64), 0, side - 1)
    return hilbert(cells)


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in a byte-level vocabulary: printable Latin-1 letters
    for themselves, the other bytes for what follows code point 255, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """The little-endian 32-bit ids of a word, by the tokenizer; words are independent.

    The tokenizer drops white space and never joins what stands on two sides of it, so a
    text's ids are those of its words in a row. Words of letters alone skip the tokenizer's
    normaliser and go to its model as that would hand them on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        body = word.rstrip(_MARKS)
        if body != word and body and self._letters_only(body):
            # marks that follow letters are a token of their own
            return self._kept(word, self[body] + self[word[len(body) :]])
        if self._letters_only(word):
            plain = word.lower() if word.isalpha() else word.decode().lower().encode()
            ids = [t.id for t in self.model.tokenize(plain.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return self._kept(word, struct.pack(f"<{len(ids)}I", *ids))

    @staticmethod
    def _letters_only(word: bytes) -> bool:
        if word.isalpha():
            return True
        try:
            text = word.decode()
        except UnicodeDecodeError:
            return False
        # the lower case of a capital sigma depends on its place, that of others has marks
        return text.isalpha() and text.lower().isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)

    def _kept(self, word: bytes, ids: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids


_WORD_IDS: dict[str, WordIds] = {}


def tokenised(text: bytes, vocabulary: str) -> bytes:
    """All ids of a text and the end id, 4 bytes each."""
    known = _WORD_IDS.get(vocabulary)
    if known is None:
        known = _WORD_IDS[vocabulary] = WordIds(vocabulary)
    return b"".join([known[w] for w in text.split()]) + END_ID.to_bytes(4, "little")


def cuts(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences for what is left: whole ones, then falling powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]


FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_TYPES = [pa.int64()] * 6 + [pa.binary()]


def _pack(vocabulary: str, with_ids: bool, length: int):
    names = ["row", *[f.split()[0] for f in FIELDS.split(", ")]]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the open sequence wait until it is known how it will be cut."""
        sequence = None
        waiting: list[tuple] = []  # (row number in its batch, batch, start, ids, doc tokens)
        size = 0

        def flush(lengths: list[int]):
            nonlocal waiting, size, sequence
            rows: list[tuple] = []
            queue = waiting[::-1]
            for n in lengths:
                at = 0
                while at < n:
                    row, start, ids, total = queue.pop()
                    take = min(len(ids) // 4, n - at)
                    part = ids[: 4 * take]
                    rows.append((row, start, take, zlib.crc32(part), total, sequence, at, part if with_ids else None))
                    if 4 * take < len(ids):
                        queue.append((row, start + take, ids[4 * take :], total))
                    at += take
                sequence += 1
            waiting = queue[::-1]
            size -= sum(lengths)
            return rows

        def batch_of(rows: list[tuple], box: pa.DataType) -> pa.RecordBatch:
            boxes = pa.concat_arrays([r[0] for r in rows])
            return pa.RecordBatch.from_arrays([boxes, *[pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(_TYPES)]], names=names)

        box = None
        for batch in batches:
            made: list[tuple] = []
            box = batch.schema.field(0).type
            if sequence is None and batch.num_rows:
                sequence = batch.column(2)[0].as_py() << 33
            for i in range(batch.num_rows):
                ids = tokenised(batch.column(1)[i].as_py() or b"", vocabulary)
                waiting.append((batch.column(0).slice(i, 1), 0, ids, len(ids) // 4))
                size += len(ids) // 4
                if size >= length:
                    made += flush([length] * (size // length))
                if len(made) >= 4096:
                    yield batch_of(made, box)
                    made = []
            if made:
                yield batch_of(made, box)
        if waiting:
            yield batch_of(flush(cuts(size, length)), box)

    return pieces


def curve_sorted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``body`` (bytes), range-sorted along the curve.

    Equal texts have one place, so the key goes on with a hash of the row: a text
    that a third of all rows hold is spread over as many ranges as its size asks for.
    """
    directions = projection()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512  # bounds the dense counts
            keys = [curve_places([v.as_py() or b"" for v in batch.column(1).slice(i, step)], directions) for i in range(0, batch.num_rows, step)]
            place = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=["row", "body", "tie", "place"])

    row = F.struct(*(keep or docs.columns)).alias("row")
    one = docs.select(row, F.col(text).cast("binary").alias("body"), F.xxhash64(*(keep or docs.columns)).alias("tie"))
    keyed = one.mapInArrow(placed, row_and(one, "body binary, tie long, place long"))
    return keyed.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie").select("row", "body")


def pack(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of sequences: ``row`` (the columns in ``keep``), place, checksum and ids.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    come. An empty table has no pieces. A long document fills sequences of its own.
    """
    ranged = curve_sorted(docs, text, keep).select("row", "body", F.spark_partition_id().cast("long").alias("range"))
    return ranged.mapInArrow(_pack(vocabulary, with_ids, length), row_and(ranged, FIELDS))
