import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motes.llm import packing as pk
from tests.llm.helpers import awkward, nothing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [2, 3, 4])
def test_hilbert_neighbours(n):
    cells = np.array(list(itertools.product(range(8), repeat=n)))
    place = pk.hilbert(cells, 3)
    assert sorted(place) == list(range(8**n))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_ids_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    random = np.random.default_rng(2)
    texts = ["Σας ΟΔΥΣΣΕΥΣ", "éa É İx", "a<|endoftext|>b <|endoftext|>", "don't I'll x's 12ab½", "\x1ca\x1cb c", "日本語 ǅ ß", "", "De,!! a$$$ é.", "e\u0301, E\u0301"]
    texts += ["".join(random.choice(list("aé.,Σ'’́İ1 \n<|>sd 日!"), 25)) for _ in range(200)]
    for t in texts:
        assert pk.tokenised(t.encode(), PATH) == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes(), t


def test_cuts():
    for n in (0, 1, 4095, 4096, 4097, 9000):
        found = pk.cuts(n)
        assert sum(found) == n and all(c == 4096 or c & (c - 1) == 0 for c in found)


def test_round_trip(spark):
    tokenizer = Tokenizer.from_file(PATH)
    df = awkward(spark).withColumn("n", F.monotonically_increasing_id())
    texts = {r.n: r.text or "" for r in df.collect()}
    pieces = pk.pack(df.repartition(3), PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.row.n].append(p)
        by_sequence[p.sequence_id].append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for n, text in texts.items():
        parts = sorted(by_doc[n], key=lambda p: p.start)
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(p.ids for p in parts) == ids and all(p.doc_tokens == len(ids) // 4 for p in parts)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        total = sum(p.length for p in parts)
        assert total == 4096 or total & (total - 1) == 0
    assert pk.pack(nothing(spark), PATH).count() == 0
