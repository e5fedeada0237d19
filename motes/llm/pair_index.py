"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a block of rows are laid out as one line of symbols. An index maps the
rank of each adjacent pair to all places where it stands. Active ranks are taken in ascending
order; a rank is applied at all its places at once, from left to right, and the pairs that this
makes are entered in their own lists. As no pair outranks those that make its parts, this
gives each word the merges that it would get alone.

A block is a run of rows of about ``BLOCK`` bytes, so the line is bounded and does not grow with the
table. What is known of a word is remembered within a bound, and texts are put together from it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import row_and
from motes.llm.packing import byte_letters

# Words whose ids a Python worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
# Bytes of text whose words are held at a time; a longer text is a block of its own.
BLOCK = 4 << 20

# Characters before this one are composed already, and each has a lower case of its own.
COMPOSED = "\u0250"

_PLAIN = re.compile(rb"[A-Za-z]+")


class PairIndex:
    """The merges of a vocabulary file, applied to many pieces at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocabulary = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids = vocabulary
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        if any(made.get(part, -1) > rank for rank, pair in enumerate(pairs) for part in pair):
            raise ValueError("a merge comes before one that makes its parts; ranks can't be applied in ascending order")
        self.left = [vocabulary[a] for a, _ in pairs]
        self.right = [vocabulary[b] for _, b in pairs]
        self.result = [vocabulary[a + b] for a, b in pairs]
        self.size = max([*vocabulary.values(), *self.added.values()]) + 1
        keys = np.array(self.left, np.int64) * self.size + np.array(self.right, np.int64)
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        self.tokens = [None] * self.size
        for token, i in [*vocabulary.items(), *self.added.items()]:
            self.tokens[i] = token
        self.gaps = None in self.tokens
        library = Tokenizer.from_file(path)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t) for t in self.added)) if self.added else None
        self.letters = byte_letters()
        self.pattern = self._pattern(file)

    @staticmethod
    def _pattern(file: dict) -> regex.Pattern | None:
        """How a word is cut, where the file only composes, puts in lower case, and cuts by one pattern."""
        normal = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            return None
        return regex.compile(steps[0]["pattern"]["Regex"])

    def pieces(self, word: bytes) -> list[str | int]:
        """What of a word is encoded by itself, in the letters of the vocabulary; added tokens as ids."""
        if _PLAIN.fullmatch(word):
            return [word.lower().decode()]
        text = word.decode("utf-8", "replace")
        if self.special and self.special.search(text):
            found: list[str | int] = []
            at = 0
            for m in self.special.finditer(text):
                found += [*self._cut(text[at : m.start()]), self.added[m.group()]]
                at = m.end()
            return found + self._cut(text[at:])
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if self.pattern and text and max(text) < COMPOSED:
            return [p.encode().decode("latin-1").translate(self.letters) for p in self.pattern.findall(text.lower())]
        return [p for p, _ in self.cut(self.normalise(text))]

    def _line(self, pieces: list[str]) -> np.ndarray:
        """The symbols of all pieces, -1 before, between and behind them."""
        letters = np.frombuffer("\0".join(["", *pieces, ""]).encode("utf-32-le"), "<u4")
        known, codes = np.unique(letters, return_inverse=True)
        inner = np.array([self.ids.get(chr(c), -2) if c else -1 for c in known.tolist()])
        last = np.array([self.ids.get(chr(c) + self.end, -2) if c else -1 for c in known.tolist()])
        ends = np.append(letters[1:] == 0, True)
        line = np.where(ends, last[codes], inner[codes])
        # letters that the vocabulary lacks have no token
        return line[line != -2]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        symbols = self._line(pieces)
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            """Places into the lists of their pairs."""
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, some in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), np.split(at, cuts), strict=False):
                if r in places:
                    places[r].append(some)
                else:
                    places[r] = [some]
                    heapq.heappush(active, r)

        enter(np.arange(n - 1), self._ranks(symbols[:-1], symbols[1:]))
        while active:
            r = heapq.heappop(active)
            a, b, new = self.left[r], self.right[r], self.result[r]
            lists = places.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            second = after[at]
            stands = (symbols[at] == a) & (symbols[second] == b)
            if a == b:
                stands &= self._from_the_left(at, second, stands)
            if not stands.all():
                at, second = at[stands], second[stands]
            following = after[second]
            symbols[at], symbols[second] = new, -2
            after[at], before[following] = following, at
            previous = before[at]
            around = np.concatenate([previous, at])
            enter(around, self._ranks(symbols[around], symbols[np.concatenate([at, following])]))
        alive = symbols != -2
        line = symbols[alive]
        borders = np.flatnonzero(line == -1)
        return [line[i + 1 : j] for i, j in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]

    @staticmethod
    def _from_the_left(at: np.ndarray, second: np.ndarray, stands: np.ndarray) -> np.ndarray:
        """Of equal symbols in a row, each pair that does not overlap the one before it."""
        taken = np.zeros(len(at), bool)
        used = -1
        for i in np.flatnonzero(stands).tolist():
            if at[i] != used:
                taken[i] = True
                used = second[i]
        return taken

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; the distinct pieces of all words share one index."""
        cut = [self.pieces(w) for w in words]
        distinct = list(dict.fromkeys(p for ps in cut for p in ps if isinstance(p, str)))
        ids = {p: i.astype("<u4").tobytes() for p, i in zip(distinct, self.encode(distinct), strict=True)}
        return [b"".join([ids[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in ps]) for ps in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with blanks between them, as the vocabulary has no decoder of its own."""
        numbers = np.frombuffer(ids, "<u4")
        if self.gaps or (len(numbers) and numbers.max() >= self.size):
            numbers = np.array([i for i in numbers.tolist() if i < self.size and self.tokens[i] is not None], "<u4")
        return " ".join(map(self.tokens.__getitem__, numbers.tolist()))


_INDEXES: dict[str, PairIndex] = {}


def _index(vocabulary: str) -> PairIndex:
    if vocabulary not in _INDEXES:
        _INDEXES[vocabulary] = PairIndex(vocabulary)
    return _INDEXES[vocabulary]


def _blocks(texts: pa.Array, most: int) -> Iterator[list[bytes]]:
    block: list[bytes] = []
    size = 0
    for v in texts:
        block.append(v.as_py() or b"")
        size += len(block[-1])
        if size >= most:
            yield block
            block, size = [], 0
    yield block


def _encoder(vocabulary: str, most: int, remembered: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(vocabulary)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            ids: list[bytes] = []
            for block in _blocks(batch.column(1), most):
                texts = [t.split() for t in block]
                words = set().union(*texts)
                fresh = [w for w in words if w not in known]
                if len(known) + len(fresh) > remembered:
                    known.clear()
                    fresh = list(words)
                known.update(zip(fresh, index.encode_words(fresh), strict=True))
                ids += [b"".join(map(known.__getitem__, ws)) for ws in texts]
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], names=["row", "n_tokens", "ids"])

    return encoded


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, block: int = BLOCK, remembered: int = REMEMBERED) -> DataFrame:
    """``row`` (the columns in ``keep``, all by default), ``n_tokens`` and ``ids``, little-endian
    unsigned 32-bit integers, of every whole text; one row for each of ``docs``, nothing is shuffled.

    Null and empty texts have no tokens, and so do texts of blanks. The strings of added tokens in a
    text are those tokens. Repeated rows are encoded as often as they come. A very long text is one
    value, like in the table. An empty table has no rows. The caller's columns are inside ``row`` and may
    have any names. ``vocabulary`` is a tokenizer file that every executor can read.
    """
    one = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text).cast("binary").alias("body"))
    return one.mapInArrow(_encoder(vocabulary, block, remembered), row_and(one, "n_tokens long, ids binary"))


def _decoder(vocabulary: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(vocabulary)
        for batch in batches:
            texts = [index.decode(v.as_py() or b"") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return decoded


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``decoded``, the text of the ids, special tokens included.

    Null and empty ids give an empty text; ids that the vocabulary does not have are passed over.
    """
    one = tokens.select(F.struct(*(keep or tokens.columns)).alias("row"), F.col(ids).alias("ids"))
    return one.mapInArrow(_decoder(vocabulary), row_and(one, "decoded string"))
