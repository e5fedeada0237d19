import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.llm import gru
from motes.llm import lm_scoring as lm
from tests.llm.helpers import awkward, nothing


def test_gradients():
    random = np.random.default_rng(0)
    docs = [random.integers(0, gru.WORDS, n) for n in (5, 9, 3, 1)]
    w = gru.Weights(*[a.astype(np.float64) for a in gru.initial(np.ones(gru.WORDS)).arrays()])
    laid = gru.lanes(docs)
    slopes, _, n = gru.gradients(w, np.zeros((laid.given.shape[1], gru.HIDDEN)), laid)
    assert n == 18
    for a, g in zip(w.arrays(), slopes.arrays()):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value, step = a[at], 1e-4
        a[at] = value + step
        up = -gru.scores(w, docs).sum()
        a[at] = value - step
        down = -gru.scores(w, docs).sum()
        a[at] = value
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3)


def test_state_is_carried_and_reset():
    random = np.random.default_rng(1)
    w = gru.initial(np.ones(gru.WORDS))
    docs = [random.integers(0, gru.WORDS, n) for n in (200, 3, 50, 50, 17)]
    together = gru.scores(w, docs)
    assert together == pytest.approx([gru.scores(w, [d])[0] for d in docs], rel=1e-5)
    total = 0.0  # one whole document, step by step
    state, given = np.zeros((1, gru.HIDDEN), np.float32), gru.START
    for x in docs[0]:
        states, _ = gru.forward(w, state, np.array([[given]]), np.array([[False]]))
        state, given = states[-1], x
        total += gru.outputs(w, states[0], np.array([x]))[0][0]
    assert together[0] == pytest.approx(total, rel=1e-5)


def test_probabilities_add_up():
    w = gru.initial(np.arange(gru.WORDS))
    state = np.random.default_rng(2).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.WORDS)
    assert np.exp(gru.outputs(w, np.repeat(state, gru.WORDS, 0), every)[0]).sum() == pytest.approx(1, rel=1e-4)


def test_training_learns():
    text = np.array([2, 3, 4, 5, 0] * 40)
    trainer = gru.Trainer(gru.initial(np.bincount(text, minlength=gru.WORDS)))
    before = gru.scores(trainer.weights, [text])[0]
    for _ in range(30):
        trainer.train([text] * 8)
    assert gru.scores(trainer.weights, [text])[0] > before / 3


@pytest.mark.parametrize("head", [400_000, 7])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    rows = [(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").collect() if r.doc_id is not None]
    rows += [(i, f"some words of {i} and {i % 7} more of some") for i in range(20, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = sorted((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.lm_scores(df, held).collect())
    words = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for x, o in zip(words, out) if not o for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((i, o, len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for (i, _), x, o in zip(rows, words, out))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_awkward_rows(spark):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    rows = lm.lm_scores(awkward(spark), held).collect()
    assert len(rows) == 10 and all(r.score < 0 for r in rows)
    assert lm.lm_scores(nothing(spark), held).count() == 0
