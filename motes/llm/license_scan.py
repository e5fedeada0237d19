"""License scans: a positional index of the rarest words of each licence template.

A template's words of highest idf, however frequent they are, are looked up; each
occurrence votes for the place where the template would have to begin. So many words are
indexed that no place with the least share can miss the votes. Only places on which the
indexed words of a template agree are compared word by word, and only those whose
mandatory phrases stand there give a label.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.llm.common import row_and

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that give a label wherever their words stand in a row.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of licence notices and texts, with their mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
]

# Least idf-weighted share of a template that must stand at its place.
LEAST_SHARE = 0.6


def file_words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _index_words(body: list[bytes], weights: list[float]) -> tuple[set[bytes], int]:
    """The words of highest weight, ties included, and how many places of them must agree.

    A place with the least share has at least so many: the places outside the index, with
    the heaviest one if two must agree, weigh less than that share.
    """
    # a little less than the share, so that rounding loses no place
    least = LEAST_SHARE * sum(weights) * (1 - 1e-9)
    heaviest = max(weights)
    agree = 2 if heaviest < least else 1
    allowed = least - (heaviest if agree == 2 else 0.0)
    for level in sorted(set(weights), reverse=True):
        if sum(x for x in weights if x < level) < allowed:
            break
    return {w for w, x in zip(body, weights) if x >= level}, agree


class Scanner:
    """Postings of the templates' words, and the scan of one file."""

    def __init__(self, frequency: Mapping[bytes, int], documents: int, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, t.encode().split(), [k.encode().split() for k in keys]) for label, t, keys in templates]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for _, t, _ in self.templates for w in t}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weights: list[list[float]] = []
        self.total: list[float] = []
        # indexed words that must agree on a place
        self.agree: list[int] = []
        for i, (_, t, _) in enumerate(self.templates):
            # words that all stand in every document weigh the same
            weights = [self.idf[w] for w in t] if any(self.idf[w] > 0 for w in t) else [1.0] * len(t)
            indexed, agree = _index_words(t, weights)
            for q, w in enumerate(t):
                if w in indexed:
                    self.postings[w].append((i, q))
            self.weights.append(weights)
            self.total.append(sum(weights))
            self.agree.append(agree)
        self.indexed = set(self.postings)
        self.heads = {p[0] for p, _ in self.phrases}

    def scan(self, text: bytes | None):
        """(words, base places, first, last, base labels, labels, score)."""
        words = file_words(text or b"")
        known = self.indexed.intersection(words)
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        score = 0.0
        if not self.heads.isdisjoint(words):
            for i, w in enumerate(words):
                if w in self.heads:
                    for p, label in self.phrases:
                        if words[i : i + len(p)] == p:
                            starts.append(i)
                            base.add(label)
        if known:
            votes: dict[tuple[int, int], set[int]] = defaultdict(set)
            for i, w in enumerate(words):
                if w in known:
                    for t, q in self.postings[w]:
                        votes[t, i - q].add(q)
            for (t, at), places in votes.items():
                if len(places) < self.agree[t]:
                    continue
                label, body, keys = self.templates[t]
                lo = max(at, 0)
                share = sum(self.weights[t][q] for q, w in enumerate(body) if 0 <= at + q < len(words) and words[at + q] == w) / self.total[t]
                if share < LEAST_SHARE:
                    continue
                near = words[max(0, lo - 2) : at + len(body) + 2]
                if all(any(near[j : j + len(k)] == k for j in range(len(near) - len(k) + 1)) for k in keys):
                    labels.add(label)
                    score = max(score, min(1.0, share))
        both = base | labels
        return (
            len(words),
            len(starts),
            starts[0] if starts else None,
            starts[-1] if starts else None,
            ",".join(sorted(base)),
            ",".join(sorted(both)),
            score,
        )


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def word_frequency(docs: DataFrame, text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, over all documents.

    Batches are counted where they are; the result has one row per template word at most.
    """
    vocabulary = {w for _, t, _ in TEMPLATES for w in t.encode().split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rows = 0
        for batch in batches:
            for value in batch.column(0):
                rows += 1
                raw = value.as_py()
                if raw:
                    found.update(vocabulary.intersection(file_words(raw)))
        names = [w.decode() for w in found]
        yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array([*found.values(), rows], pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {r.word: r.n for r in counted.collect()}
    documents = rows.pop(None, 0)
    return {w.encode(): n for w, n in rows.items()}, documents


def license_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) as ``row``, and what was found in each whole text.

    Null and empty texts have no words and no labels, score 0. Repeated rows are found
    alike. One narrow pass over the text after one that counts; no shuffle of texts.
    """
    frequency, documents = word_frequency(docs, text)
    scanner = Scanner(frequency, documents)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(value.as_py()) for value in batch.column(1)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *_NAMES])

    row = F.struct(*(keep or docs.columns)).alias("row")
    boxed = docs.select(row, F.col(text).cast("binary").alias("_text"))
    return boxed.mapInArrow(scan, row_and(boxed, FIELDS))
