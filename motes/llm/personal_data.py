"""Personal data: fixed patterns, and a semi-Markov conditional random field over segments.

The field scores whole candidate spans (a piece of text together with a type) by features
of the span: its characters, its digits, its check sum, its neighbours. A dynamic program over the
places of a window, with entities of bounded length, finds the best division into entities
and single atoms outside; boundaries and types are chosen together. It is trained here, on
windows that the fixed patterns label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import row_and

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Entities are at most so many characters long, windows reach so far around digits and @.
LONGEST = 64
AROUND = 24
# Training windows (a bounded sample by hash of the window), passes over them, and how far
# an entity must outscore the outside to be added.
TRAINING_WINDOWS = 800
EPOCHS = 4
MARGIN = 4.0

Span = tuple[int, int, str]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def addresses(text: str) -> list[Span]:
    """All matches of the address pattern, from each @ back: a search from every place on would
    take the square of the length of a long word."""
    found: list[Span] = []
    behind = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > behind and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        behind = m.end() if m else at + 1
        if m:
            found.append((start, m.end(), "email"))
        at = text.find("@", behind)
    return found


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find: leftmost, not overlapping within a kind, and valid.

    A match that fails its test is dropped, and the search goes on behind it.
    """
    found = addresses(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


FEATURES = (
    "bias", "left edge", "right edge", "one @", "dot after @", "local part", "letters", "four numbers", "numbers to 255",
    "7 to 9 digits", "10 to 12 digits", "13 to 15 digits", "16 to 19 digits", "check sum", "plus", "brackets", "groups", "blank", "long group", "odd mark",
)


def features(window: str, start: int, end: int) -> np.ndarray:
    """Of the span as a whole, and of the characters beside it."""
    s = window[start:end]
    before, after = window[start - 1 : start], window[end : end + 1]
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    at = s.find("@")
    return np.array(
        [
            1.0,
            not (before.isalnum() or before in ("+", "@", "=", "_", '"') and before != ""),
            not (after.isalnum() or after in ("@", "_", '"') and after != "" or after in (".", "-") and window[end + 1 : end + 2].isalnum()),
            s.count("@") == 1,
            at > 0 and "." in s[at:] and s[-1:].isalnum(),
            at > 0 and bool(re.fullmatch(r"[\w.%+-]+", s[:at])),
            any(c.isalpha() for c in s),
            bool(re.fullmatch(r"[0-9]{1,3}([.][0-9]{1,3}){3}", s)),
            len(groups) == 4 and all(int(g[-4:]) <= 255 for g in groups),
            7 <= n <= 9,
            10 <= n <= 12,
            13 <= n <= 15,
            16 <= n <= 19,
            n >= 13 and luhn("".join(groups)),
            s[:1] == "+",
            "(" in s and ")" in s,
            len(groups) >= 3,
            " " in s,
            any(len(g) >= 6 for g in groups),
            bool(re.search(r"[^\w.%+@() -]", s)),
        ],
        dtype=np.float64,
    )


_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_MARKED = re.compile(r"[0-9@]")


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @; nothing outside them can be part of an entity.

    A window ends at white space or at the reach around its last digit or @, whatever
    comes first beyond; near ones are joined.
    """
    start = end = None
    for m in _MARKED.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.start() + AROUND)
        if end is not None and lo <= end:
            end = hi
        else:
            if end is not None:
                yield start, end
            start, end = lo, hi
    if end is not None:
        yield start, end


def candidates(window: str) -> tuple[list[int], list[tuple[int, int, int, np.ndarray]]]:
    """Borders of the atoms, and (first border, last border, kind, features) of each span
    that a kind may take: an address holds one @ and no white space, the others at least
    seven digits (four numbers) and no letters."""
    borders = [m.start() for m in _ATOM.finditer(window)] + [len(window)]
    n = len(borders) - 1
    atoms = [window[borders[i] : borders[i + 1]] for i in range(n)]
    out = []
    for i in range(n):
        first = atoms[i][0]
        if not (first.isalnum() or first in "+("):
            continue
        ats = digits = numbers = letters = blanks = 0
        for j in range(i, n):
            a = atoms[j]
            if borders[j + 1] - borders[i] > LONGEST or a in ("\n", "\r", "\t"):
                break
            if a[0].isdigit():
                digits += len(a)
                numbers += 1
            elif a[0].isalpha():
                letters += 1
            ats += a == "@"
            blanks += a == " "
            if not a[-1].isalnum() or ats > 1:
                if ats > 1:
                    break
                continue
            s = None
            if ats == 1 and not blanks and first not in "+(":
                s = features(window, borders[i], borders[j + 1])
                out.append((i, j + 1, 0, s))
            if not ats and not letters and 7 <= digits <= 19:
                s = features(window, borders[i], borders[j + 1])
                out.extend((i, j + 1, k, s) for k in ((1, 2, 3) if numbers == 4 else (2, 3)))
            elif not ats and not letters and numbers == 4:
                out.append((i, j + 1, 1, features(window, borders[i], borders[j + 1])))
    return borders, out


def best_segments(window: str, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best division: (start, end, kind, score above the outside) of its entities."""
    borders, spans = candidates(window)
    if not spans:
        return []
    ends: dict[int, list] = {}
    for i, j, k, x in spans:
        ends.setdefault(j, []).append((i, k, float(weights[k] @ x)))
    best = [0.0] * len(borders)
    back: list[tuple | None] = [None] * len(borders)
    for j in range(1, len(borders)):
        best[j] = best[j - 1]  # one atom outside scores 0
        for i, k, score in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, k, score)
    out, j = [], len(borders) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k, score = back[j]
            out.append((borders[i], borders[j], k, score))
            j = i
    return out[::-1]


def _gradient(borders, spans, gold: set, weights: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Of the log-likelihood: features of the labelled spans less their expectation."""
    n = len(borders)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for s, (i, j, _, _) in enumerate(spans):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    ahead, behind = np.zeros(n), np.zeros(n)
    for j in range(1, n):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[spans[s][0]] + scores[s] for s in by_end.get(j, ())]])
    for i in range(n - 2, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[spans[s][1]] + scores[s] for s in by_start.get(i, ())]])
    slope = np.zeros_like(weights)
    for s, (i, j, k, x) in enumerate(spans):
        p = np.exp(min(0.0, ahead[i] + scores[s] + behind[j] - ahead[-1]))
        slope[k] += ((borders[i], borders[j], KINDS[k]) in gold) * x - p * x
    return slope


def train(examples: Sequence[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights by stochastic ascent with per-weight step sizes.

    Features are dropped at random in training, so that no single one, such as a leading
    plus, carries a kind alone.
    """
    random = np.random.default_rng(seed)
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -1.0
    square = np.full_like(weights, 1e-2)
    prepared = [(*candidates(w), set(gold)) for w, gold in examples]
    for _ in range(epochs):
        for at in random.permutation(len(prepared)):
            borders, spans, gold = prepared[at]
            if not spans:
                continue
            mask = random.random(len(FEATURES)) > 0.1
            mask[0] = True
            thin = [(i, j, k, x * mask) for i, j, k, x in spans]
            scores = np.array([weights[k] @ x for _, _, k, x in thin])
            slope = _gradient(borders, thin, gold, weights, scores) - 1e-4 * weights
            square += slope * slope
            weights += 0.5 * slope / np.sqrt(square)
    return weights


def all_spans(text: str, base: list[Span], weights: np.ndarray | None) -> list[Span]:
    """The base spans, and the field's own that touch none of them and clearly win."""
    if weights is None or not _MARKED.search(text):
        return base
    taken = [(s, e) for s, e, _ in base]
    more = []
    for lo, hi in windows(text):
        for s, e, k, score in best_segments(text[lo:hi], weights):
            s, e = s + lo, e + lo
            if score >= MARGIN and all(e <= a or b <= s for a, b in taken):
                more.append((s, e, KINDS[k]))
    return sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spelt(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def fitted(docs: DataFrame, text: str = "text", most: int = TRAINING_WINDOWS) -> np.ndarray | None:
    """Weights from at most ``most`` windows with candidates, the lowest by hash over all documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str]] = []
            for value in batch.column(0):
                t = value.as_py() or ""
                if not _MARKED.search(t):
                    continue
                base = base_spans(t)
                for lo, hi in windows(t):
                    if hi - lo <= 8 * LONGEST and candidates(t[lo:hi])[1]:
                        found.append((t[lo:hi], spelt([(s - lo, e - lo, k) for s, e, k in base if lo <= s and e <= hi])))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["window", "spans"])

    cuts = docs.select(F.col(text)).mapInArrow(cut, "window string, spans string")
    rows = cuts.distinct().orderBy(F.xxhash64("window"), "window", "spans").limit(most).collect()
    if not rows:
        return None
    examples = []
    for r in rows:
        gold = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        examples.append((r.window, gold))
    return train(examples)


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """``row``, counts per kind and spelling of the base spans, and ``spans``, all of them.

    ``kind:start:end``, in code points, end exclusive, by start and kind. Null and empty texts
    have none. Repeated rows are judged alike. Where no text holds a digit or an @ nothing
    is trained and the base spans are all. Narrow passes only.
    """
    if weights is None:
        weights = fitted(docs, text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {k: [] for k in KINDS}
            base_out, span_out = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                base = base_spans(t)
                for k in KINDS:
                    counts[k].append(sum(x[2] == k for x in base))
                base_out.append(spelt(base))
                span_out.append(spelt(all_spans(t, base, weights)))
            arrays = [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(base_out, pa.string()), pa.array(span_out, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *[f.split()[0] for f in FIELDS.split(", ")]])

    row = F.struct(*(keep or docs.columns)).alias("row")
    one = docs.select(row, F.col(text).alias("_text"))
    return one.mapInArrow(find, row_and(one, FIELDS))


def marked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping ones the first leaves its mark."""
    at, parts = 0, []
    for s, e, kind in spans:
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets.

    Overlapping spans become one mark, of the first. A null text stays null. Spans are found and replaced
    in one pass: a task with two passes holds two Python workers, which stay beside those of later stages.
    """
    weights = fitted(docs, text)

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                t = value.as_py()
                out.append(marked(t, all_spans(t, base_spans(t), weights)) if t else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "hidden"])

    box = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_text"))
    clean = box.mapInArrow(hide, row_and(box, "hidden string"))
    columns = [F.col("hidden").alias(c) if c == text else F.length("hidden").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns]
    return clean.select(*columns)
