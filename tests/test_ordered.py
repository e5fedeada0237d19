"""Chunked building blocks against plain Python, with one key holding a third of the rows."""

import datetime
import decimal
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motes.operators import ordered

SMALL = {"splits": 7}


def rows(n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])
        value = rng.choice([None, 0.5, 0.5, 0.5, rng.gauss(0, 1), rng.gauss(5, 2)])
        out.append((i * 3 + rng.randrange(3), key, value))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "_row bigint, key string, value double").repartition(5)


def groups(data):
    out = {}
    for row, key, value in sorted(data):
        out.setdefault(key, []).append((row, value))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 20])
def test_position(df, data, chunk):
    got = {r["_row"]: r["_pos"] for r in ordered.position(df, ["key"], chunk=chunk).collect()}
    want = {row: i for g in groups(data).values() for i, (row, _) in enumerate(g)}
    assert got == want


def test_position_of_scattered_ids(spark):
    rng = random.Random(6)
    ids = sorted(rng.sample(range(-(1 << 60), 1 << 60), 200))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(3)
    got = {r["id"]: r["_pos"] for r in ordered.position(df, [], "id", chunk=1 << 20, sparse=True).collect()}
    assert got == {v: i for i, v in enumerate(ids)}


def test_position_without_keys(df, data):
    got = {r["_row"]: r["_pos"] for r in ordered.position(df, [], chunk=50).collect()}
    assert got == {row: i for i, (row, _, _) in enumerate(sorted(data))}


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(df, data, inclusive, sparse):
    outs = {
        "s": ("sum", F.col("value")),
        "lo": ("min", F.col("value")),
        "hi": ("max", F.col("value")),
        "prev": ("lag", F.col("value")),
    }
    got = {r["_row"]: r for r in ordered.running(df, ["key"], "_row", outs, inclusive, chunk=11, sparse=sparse).collect()}
    for g in groups(data).values():
        for i, (row, _) in enumerate(g):
            seen = [v for _, v in g[: i + inclusive] if v is not None]
            r = got[row]
            assert (r["lo"], r["hi"]) == ((min(seen), max(seen)) if seen else (None, None))
            assert r["s"] == (pytest.approx(sum(seen)) if seen else None)
            assert r["prev"] == (g[i - 1][1] if i else None)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_ranked(df, data, descending, keys):
    got = {r["_row"]: r["_rank"] for r in ordered.ranked(df, keys, "value", descending=descending, chunk=40, **SMALL).collect()}
    plain = {r["_row"]: r["_rank"] for r in ordered.ranked(df, keys, "value", descending=descending).collect()}
    want = {}
    for g in (groups(data) if keys else {0: [(r, v) for r, _, v in data]}).values():
        def place(rv):
            none = rv[1] is None
            value = 0 if none else -rv[1] if descending else rv[1]
            return (none if descending else not none, value, rv[0])
        want |= {row: i for i, (row, _) in enumerate(sorted(g, key=place))}
    assert got == plain == want


def test_known_cuts_give_the_same_ranks(df):
    a = {(r["_row"], r["_rank"]) for r in ordered.ranked(df, ["key"], "value", cuts=[0.0, 0.5, 4.0]).collect()}
    assert a == {(r["_row"], r["_rank"]) for r in ordered.ranked(df, ["key"], "value").collect()}


def test_percentiles(df, data):
    fractions = {"p10": 0.1, "p70": 0.7, "top": 1.0}
    for options in ({}, SMALL):
        got = {r["key"]: r for r in ordered.percentiles(df, ["key"], "value", fractions, **options).collect()}
        for key, g in groups(data).items():
            values = [v for _, v in g if v is not None]
            for name, p in fractions.items():
                assert got[key][name] == pytest.approx(np.percentile(values, p * 100))


def test_order_statistics_without_keys(df, data):
    values = sorted(v for _, _, v in data if v is not None)
    picks = {"third": F.lit(2), "mid": F.floor(F.col("_n") / 2)}
    for options in ({}, SMALL):
        r = ordered.order_statistics(df, [], "value", picks, **options).first()
        assert (r["third"], r["mid"], r["n"]) == (values[2], values[len(values) // 2], len(values))


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_any_partitioning_gives_the_same_result(spark, data, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        shuffled = spark.createDataFrame(sorted(data, key=lambda r: hash(r)), "_row bigint, key string, value double").repartition(partitions)
        out = ordered.ranked(ordered.position(shuffled, ["key"], chunk=30), ["key"], "value", chunk=9, **SMALL)
        got = sorted((r["_row"], r["_pos"], r["_rank"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {row: i for g in groups(data).values() for i, (row, _) in enumerate(g)}
    assert [(a, b) for a, b, _ in got] == sorted(want.items())


def test_many_splitters(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([rng.random(), 0.25])) for i in range(3000)]
    df = spark.createDataFrame(data, "_row bigint, value double")
    got = {r["_row"]: r["_rank"] for r in ordered.ranked(df, [], "value", splits=2000, chunk=100).collect()}
    assert got == {row: i for i, (row, _) in enumerate(sorted(data, key=lambda d: (d[1], d[0])))}


@pytest.mark.parametrize("edges", [[1.0], [1.0, 2.0], [0.5, 1.5, 2.5, 1e300], list(range(100))])
def test_count_at_most(spark, edges):
    values = [-1.0, 0.5, 1.0, 1.7, 2.0, 50.0, 99.0, 1e301, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(ordered.count_at_most(F.col("v"), edges)).collect()]
    assert got == [len(edges) if v != v else sum(e <= v for e in edges) for v in values]


@pytest.mark.parametrize("splits", [None, 3])
@pytest.mark.parametrize("descending", [False, True])
def test_values_compare_in_their_own_type(spark, splits, descending):
    columns = {
        "bigint": [2**60 + i for i in (3, 1, 5, 0, 2, 4, 5)] + [None],
        "string": ["b", "a,b", "", "10", "9", 'q"', None, "a"],
        "double": [None] * 8,
        "float": [float("nan")] * 7 + [1.0],
        "decimal(20,3)": [decimal.Decimal(f"12345678901234567.{i}00") for i in range(8)],
        "date": [datetime.date(2020, 1, 1 + i % 3) for i in range(8)],
    }
    for kind, values in columns.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_row bigint, v {kind}").repartition(3)
        order = F.col("v").desc() if descending else F.col("v").asc()
        want = {r["_row"]: r["w"] for r in df.select("_row", (F.row_number().over(Window.orderBy(order, "_row")) - 1).alias("w")).collect()}
        got = {r["_row"]: r["_rank"] for r in ordered.ranked(df, [], "v", descending=descending, splits=splits, chunk=2).collect()}
        assert got == want, kind


@pytest.mark.parametrize("kind", ["double", "bigint", "float", "int"])
@pytest.mark.parametrize("border", [20, 100_000])
def test_order_statistics_of_a_whole_table(spark, kind, border):
    rng = random.Random(6)
    values = [rng.choice([3, 3, rng.randrange(5000)]) for _ in range(3000)]
    if kind == "bigint":
        values = [v + (1 << 60) for v in values]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 7, "v bigint").select(F.col("v").cast(kind).alias("v")).repartition(3)
    n = F.col("_n")
    picks = {"first": F.lit(0), "low": F.floor(n * 0.1), "mid": F.floor(n / 2), "last": n - 1}
    want = sorted(values)
    for got in (ordered._whole_table(df, "v", picks, border=border), ordered.order_statistics(df, [], "v", picks, splits=3).select("n", *picks)):
        if got is not None:
            assert tuple(got.first()) == (3000, want[0], want[300], want[1500], want[-1])
    assert border == 20 or ordered._whole_table(df, "v", picks) is not None
    assert ordered.order_statistics(df.filter("v < 0"), [], "v", picks).first()["mid"] is None
