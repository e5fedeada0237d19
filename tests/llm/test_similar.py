import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.llm import exact_substrings as es
from motes.llm import near_dedup as nd
from motes.llm import prefix_forest as pf
from motes.llm.components import components
from motes.llm.prefix_forest import nearest
from tests.llm.helpers import awkward, nothing


def brute_groups(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def near_texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 100
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 60, 200]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((k := k + 1, " ".join(copy)))
    # a chain, each near the next alone, and texts around one common passage
    chain = [f"c{i}" for i in range(120)]
    rows += [((k := k + 1), " ".join(chain[i : i + 100])) for i in range(0, 20, 5)]
    return [*rows, (1, None), (2, ""), (3, "one"), (4, "One"), (5, " one ")]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.id, r.n, r.component) for r in nd.near_duplicates(df, words=words).collect())
    assert got == sorted(brute_groups(rows, words, 80))


@pytest.mark.parametrize("whole", [256, 0])
def test_small_tiles_find_the_same(spark, monkeypatch, whole):
    monkeypatch.setattr(nd, "TILE", 3)
    monkeypatch.setattr(nd, "WHOLE", whole)
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.n, r.component) for r in nd.near_duplicates(df, words=4).collect())
    assert got == sorted(brute_groups(rows, 4, 80))


def test_estimates():
    rng = np.random.default_rng(0)
    all_ = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for same in (0.5, 0.8, 0.95):
        n = int(1000 * same * 2 / (1 + same))
        a, b = np.unique(all_[:1000]), np.unique(np.r_[all_[:n], all_[2000 : 3000 - n]])
        value = nd.estimated(nd.registers(a), nd.registers(b)[None], 0.0)[0]
        assert abs(value - same) < 0.15
        value = nd.estimated(nd.fine_registers(a), nd.fine_registers(b)[None], nd.FINE_CHANCE)[0]
        assert abs(value - same) < 0.05


def test_keep_one(spark):
    df = awkward(spark)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    # 6 is near 5; blank and null texts are near nothing; of repeated rows one stays
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7]
    assert nd.keep_one(nothing(spark)).count() == 0


def test_keep_one_of_copies_without_ids(spark):
    """A third of all rows is one row without an id; other copies differ in their other columns."""
    text = "one two three four five six seven"
    rows = [(None, text, "a")] * 200 + [(i, f"own words of row {i} {i + 1} {i + 2}", "b") for i in range(200)] + [(7, f"own words of row {7} {8} {9}", c) for c in "xyz"]
    rows += [(None, "alone without an id here now", None), (900, "", "a"), (900, "", "a")]
    kept = nd.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert Counter(r.doc_id for r in kept) == Counter({None: 2, 900: 2, **dict.fromkeys(range(200), 1)})
    assert {r.text for r in kept if r.doc_id is None} == {text, "alone without an id here now"}


@pytest.mark.parametrize("length", [60, 400])
def test_a_crowd_just_below_the_threshold(spark, length):
    """Copies with changes that are mostly no links; sets below and above those that tiles compare whole."""
    rng = random.Random(length)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(length), max(1, length // 45) if i % 10 else 1):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = sorted((r.id, r.n, r.component) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted(brute_groups(rows, 5, 80))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 120), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 120: 99}


def brute_cut(bodies):
    seen = Counter(b[i : i + es.SPAN] for b in bodies for i in range(len(b) - es.SPAN + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - es.SPAN + 1):
            if seen[b[i : i + es.SPAN]] > 1:
                gone[i : i + es.SPAN] = b"\1" * es.SPAN
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))

    shared = [words(120), words(200), words(60)]
    texts = []
    for i in range(40):
        parts = [words(rng.randint(0, 150)) for _ in range(3)]
        for p in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randrange(0, 80)
            parts.insert(rng.randrange(3), p[at:] if rng.random() < 0.5 else p[: 399 + rng.randrange(3)])
        texts.append("".join(parts))
    texts += ["ab" * 500, "ab" * 300 + "x", "a" * 401, "q" + "a" * 399, None, "", texts[0], shared[0], shared[0] + shared[0], "x" * 398]
    return texts


@pytest.mark.parametrize("most", [es.MOST_UNITS, 2])
def test_exact_substrings(spark, monkeypatch, most):
    monkeypatch.setattr(es, "MOST_UNITS", most)
    texts = passages()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_cut([(t or "").encode() for t in texts])
    got = es.without_repeats(df).select("row.doc_id", "n_bytes", "n_removed", F.size("spans").alias("k"), "kept_sha256").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def brute_shared(bodies, words):
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in bodies]
    windows = [[b[p[i][0] : p[i + words - 1][1]] for i in range(len(p) - words + 1)] for b, p in zip(bodies, places)]
    rows = Counter(w for ws in windows for w in set(ws))
    return [len({i + k for i, w in enumerate(ws) if rows[w] > 1 for k in range(words)}) for ws in windows]


@pytest.mark.parametrize("most", [es.MOST_UNITS, 1])
def test_shared_passages_below_the_span(spark, monkeypatch, most):
    """Passages of over 50 words that have fewer than 400 bytes are reported, and not removed."""
    monkeypatch.setattr(es, "MOST_UNITS", most)
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))

    planted = [words(n) for n in (50, 51, 52, 55)]
    texts = [" ".join([words(rng.randint(0, 200)), p, words(rng.randint(0, 90))]) for p in planted for _ in range(3)]
    texts += [planted[1], f"{planted[2]}\n{words(30)}\t{planted[2]}", planted[3].replace(" ", "  ", 1)]
    own = words(60)
    texts += [f"{own} {words(5)} {own}", *[words(70)] * 2, *[words(20)] * 2, words(300), "x" * 900, None, "", " \n"]
    near = words(400).split(" ")
    texts += [" ".join([*near[:k], "changed", *near[k + 1 :]]) for k in (30, 200, 330)]
    texts += passages()
    want = brute_shared([(t or "").encode() for t in texts], 51)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in es.without_repeats(df, words=51).select("row.doc_id", "n_shared_words", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()}
    cut = brute_cut([(t or "").encode() for t in texts])
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == (want[i], *cut[i]), (i, text)
    assert [want[i] >= 51 for i in range(13)] == [False] * 3 + [True] * 10
    assert not any(got[i][2] for i in range(3, 13))  # too short for the rule of 400 bytes
    rows = es.without_repeats(awkward(spark), words=51)
    assert rows.count() == awkward(spark).count() and "n_shared_words" in rows.columns
    assert es.without_repeats(nothing(spark), words=51).count() == 0


def test_cover_and_chunks(monkeypatch):
    assert {(a - b) % es.PERIOD for a in es.COVER for b in es.COVER} == set(range(es.PERIOD))
    body = random.Random(3).randbytes(5000)
    whole = es.anchors(body)
    monkeypatch.setattr(es, "CHUNK", 700)
    parts = es.anchors(body)

    def by_start(found):
        return {s: p for _, p, lo, n in zip(*found) for s in range(lo, lo + n)}

    assert by_start(whole) == by_start(parts)
    assert sorted(by_start(whole)) == list(range(5000 - es.SPAN + 1))


def test_word_windows_in_chunks(monkeypatch):
    rng = random.Random(4)
    bodies = [b" \n".join(rng.randbytes(rng.randint(1, 9)).hex().encode() for _ in range(n)) for n in (900, 0, 50, 51, 70)]
    bodies += [b"y" * 3000 + b" z" * 80, b"", bodies[0]]

    def by_start(found):
        out = {}
        for d, h, lo, n, windows in found:
            for i, anchor, first, end, m in zip(d.tolist(), h.tolist(), lo.tolist(), np.cumsum(n).tolist(), n.tolist()):
                out |= {(i, first + k): (anchor, int(windows[end - m + k])) for k in range(m)}
        return out

    whole = by_start(es.word_units(bodies, 51))
    for size in (700, 1200, 1537, 20000):
        monkeypatch.setattr(es, "CHUNK", size)
        monkeypatch.setattr(es, "_UP", es._UP[: size + 400])
        monkeypatch.setattr(es, "_DOWN", es._DOWN[: size + 400])
        assert by_start(es.word_units(bodies, 51)) == whole
        for i, body in enumerate(bodies):
            alone = [x for _, _, lo, n, _ in es.word_units([body], 51) for x in zip(lo.tolist(), n.tolist())]
            assert alone == [x[1:] for d, _, lo, n, _ in es.word_units(bodies, 51) for x in zip(d.tolist(), lo.tolist(), n.tolist()) if x[0] == i]
        monkeypatch.undo()
    assert sorted(whole) == [(i, k) for i, b in enumerate(bodies) for k in range(len(b.split()) - 50)]
    assert len({w for _, w in whole.values()}) == len({b" \n".join(b.split()[k : k + 51]) for b in bodies for k in range(len(b.split()) - 50)})


def test_substrings_of_awkward_rows(spark):
    df = awkward(spark)
    assert es.without_repeats(df).count() == df.count()
    assert es.without_repeats(nothing(spark)).count() == 0


def test_forest(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[500:] = v[0]
    rows = [(i, [float(x) for x in v[i]], "e") for i in range(600)]
    rows += [(700, None, "e"), (701, [0.0] * 16, "e"), (702, [float("nan")] * 16, "e"), (703, [1.0] * 3, "e"), (None, [1.0] * 16, "e"), (704, [None] + [1.0] * 15, "e"), rows[20], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls string").repartition(3)
    got = nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        best = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:5]
        mine = [r.vec_id for r in got if r.query_id == q]
        assert len(mine) == 5 and [r.rank for r in got if r.query_id == q] == [1, 2, 3, 4, 5]
        hit += len(set(best) & set(mine))
        assert np.allclose([r.score for r in got if r.query_id == q], s[mine])
        if q in (0, 500, 550):
            assert mine == best  # copies: the smallest ids
    assert hit >= 0.9 * 60
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(df.filter("vec_id IN (0, 7, 9)"), F.col("vec_id") == 0).count() == 2


def test_forest_in_many_pieces(spark, monkeypatch):
    """Prefixes cross the pieces' edges: answers do not depend on where trees are cut."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 16)).astype(np.float32)
    v[1500:] = v[7] * (1 + np.arange(500, dtype=np.float32)[:, None])  # one string in each tree, other vectors
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    kinds = {"whole trees": {"candidates": 2.0, "growth": 1.0}, "prefixes": {"candidates": 0.2, "growth": 1.0}}
    got, recall = {}, {}
    for rows in (pf.ROWS_PER_TASK, 1000, 100):
        monkeypatch.setattr(pf, "ROWS_PER_TASK", rows)
        for kind, asked in kinds.items():
            found = nearest(df, F.col("vec_id") % 50 == 0, trees=2, **asked).orderBy("query_id", "rank").collect()
            got[kind, rows] = [tuple(r) for r in found]
            near = {(r.query_id, round(r.score, 6)) for r in found}
            best = {q: np.sort(np.delete(unit @ unit[q], q))[::-1][:5] for q in range(0, 1500, 50)}
            recall[kind, rows] = float(np.mean([(q, round(float(x), 6)) in near for q, b in best.items() for x in b]))
    print("recall", recall)
    for kind in kinds:
        assert got[kind, 100] == got[kind, 1000] == got[kind, 60_000] and len(got[kind, 100]) == 40 * 5
    assert recall["whole trees", 100] == 1.0
