import pytest
from pyspark.sql import functions as F

from motes.llm.mixing import mixed, repeated, targets
from motes.llm.quality_rules import keep_good, quality_rules
from tests.llm.helpers import awkward, nothing


def brute(text):
    words = (text or "").split() if text and text.isascii() else [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_counts(spark):
    texts = [
        "a b c d e a b c d e a b c d e f",
        "a a a a a a",
        "a b c d",
        "x # y\n\nx # y\n z|\n \nx # y",
        "é\u00a0ß l\x0bm\x0cn",
        "a b c d e f g a b c d e q r b c d e f s",
        None,
        "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality_rules(df).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), texts[r.doc_id]


def test_rules_on_awkward_rows(spark):
    df = awkward(spark)
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 4, 5, 6]
    assert keep_good(nothing(spark)).count() == 0
    junk = spark.createDataFrame([(1, "word### " * 40), (2, "SHOUT!! LOUD!! " * 3 + "AND!! MORE!! WORDS!! HERE!! ARE!! SOME!!")], "doc_id long, text string")
    assert keep_good(junk).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 0, "b": 5}, {"a": 1, "b": 1, "c": 1, "d": 900, None: 50}, {"a": 7}])
def test_targets(spark, sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    total, share = sum(sizes.values()), {}
    open_ = set(sizes)
    left = total
    while True:  # cap and reshare
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]} if w else set()
        if not over:
            share |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            share[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(share)


def test_mix(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("source"), F.repeat(F.lit("w "), 20).alias("text"))
    m = mixed(df).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"))
    for r in m.collect():
        assert r.taken == pytest.approx(r.target, rel=0.1) and r.most <= 3
    assert repeated(df).count() == mixed(df).agg(F.sum("copies")).first()[0]
    assert sorted(map(str, mixed(df).select("row.doc_id", "copies").collect())) == sorted(map(str, mixed(df).repartition(7).select("row.doc_id", "copies").collect()))
    df = awkward(spark)
    assert repeated(df).columns == df.columns
    assert mixed(df).count() == df.count()
    assert mixed(nothing(spark)).count() == 0
