import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.operators import ranking, views
from motes.operators.selection import first_rows


@pytest.mark.parametrize("asked,kept", [(50, 49), (200, 199), (350, 350), (400, 400)])
def test_rounding_can_drop_the_last_view(asked, kept):
    assert len(views.even_views(asked)) == kept


def point(rot, tilt, compat):
    k = 0.01745329251
    return (math.sin(tilt * k) * math.cos(rot * k), math.sin(tilt * k) * math.sin(rot * k), (math.sin if compat else math.cos)(tilt * k))


def nearest(rot, tilt, angles, compat):
    p = point(rot, tilt, compat)
    return min(range(len(angles)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(p, point(*angles[i], compat))), i))


def particles(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < 0.34:  # one crowded direction
            rot, tilt = rng.gauss(40, 2), rng.gauss(70, 2)
        else:
            rot, tilt = rng.uniform(-400, 400), rng.uniform(-10, 200)
        out.append((i, rot, tilt, rng.choice([1, 2, 2]), round(rng.gauss(0.2, 1), 2)))
    return out


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("count", [25, 150])
def test_nearest_view(spark, compat, count):
    data = particles(600, count)
    df = spark.createDataFrame(data, "_row bigint, rot double, tilt double, subset int, score double")
    angles = views.even_views(count)
    got = {r["_row"]: r["view"] for r in views.nearest_view(df, count, compat=compat).collect()}
    assert got == {row: nearest(rot, tilt, angles, compat) for row, rot, tilt, _, _ in data}


def ranks(data, count, normalise=True):
    """The ranking spelled out: views, layers inside views, order inside layers."""
    angles = views.even_views(count)
    out = {}
    for half in (1, 2):
        mine = [d for d in data if (d[3] == 1) == (half == 1)]
        by_view = {}
        for d in mine:
            by_view.setdefault(nearest(d[1], d[2], angles, True), []).append(d)
        layers = {}
        for view, members in by_view.items():
            members.sort(key=lambda d: (-d[4], d[0]))
            best = members[0][4]
            for layer, d in enumerate(members):
                norm = d[4] / best if best > 0 and layer > 0 and normalise else d[4]
                layers.setdefault(layer, []).append((-norm, view, d[0]))
        place = 0
        for layer in sorted(layers):
            for _, _, row in sorted(layers[layer]):
                out[row] = place / len(mine)
                place += 1
    return out


@pytest.mark.parametrize("options", [{}, {"splits": 5}])
@pytest.mark.parametrize("normalise", [True, False])
def test_equalised_rank(spark, options, normalise):
    data = particles(700, 3)
    df = spark.createDataFrame(data, "_row bigint, rot double, tilt double, subset int, score double").repartition(3)
    out = ranking.equalised_rank(df, 30, half="subset", normalise=normalise, **options)
    got = {r["_row"]: r["rank"] for r in out.collect()}
    assert got == pytest.approx(ranks(data, 30, normalise))


def test_selection_is_exact_or_truncated(spark):
    df = spark.createDataFrame([(i, 10 - i, float(10 - i)) for i in range(10)], "_row bigint, x int, _t_norm7846 double")
    assert ranking.find_rank_column(df) == "_t_norm7846"
    assert [r["_row"] for r in ranking.select_ranked(df, 3).orderBy("_row").collect()] == [7, 8, 9]
    assert [r["_row"] for r in ranking.select_ranked(df, 3, worst=True).orderBy("_row").collect()] == [0, 1, 2]
    assert ranking.select_ranked(df, 100).count() == 10
    with pytest.raises(ValueError):
        ranking.select_ranked(df, 100, exact=True)


def test_selection_cut_in_pieces(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([1.0, 1.0, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(data, "_row bigint, v double")
    for n in (0, 1, 170, 499):
        got = {r["_row"] for r in ranking.select_ranked(df, n, "v", border=16).collect()}
        assert got == {row for row, _ in sorted(data, key=lambda d: (d[1], d[0]))[:n]}


def test_number_in_runs(spark):
    rng = random.Random(9)
    stacks = [rng.choice("ab") for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(stacks)), "_row bigint, stack string").repartition(4)
    got = {r["_row"]: r["number"] for r in ranking.number_in_runs(df, "stack", chunk=7).collect()}
    number, want = 0, {}
    for i, s in enumerate(stacks):
        number = number + 1 if i and stacks[i - 1] == s else 1
        want[i] = number
    assert got == want


def test_checkpoint_counts(spark):
    df = spark.range(100).select(F.col("id").alias("_row"), (99 - F.col("id")).cast("double").alias("rank"), (F.col("id") % 2).alias("half"))
    got = {(r["checkpoint"], r["half"]): r["n"] for r in ranking.checkpoint_counts(df, [10, 35], "rank", ["half"]).collect()}
    assert got == {(10, 0): 5, (10, 1): 5, (35, 0): 17, (35, 1): 18}


def test_ids_continue(spark):
    old = spark.createDataFrame([("P000007",), ("X000099",), ("P12",)], "name string")
    new = spark.createDataFrame([(4,), (2,)], "_row bigint")
    got = {r["_row"]: r["particle_name"] for r in ranking.assign_ids(new, old).collect()}
    assert got == {2: "P000013", 4: "P000014"}
    empty = old.filter("name = 'none'")
    assert {r["particle_id"] for r in ranking.assign_ids(new, empty, start=5).collect()} == {5, 6}


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "timestamp", "decimal(20,3)"])
def test_first_rows_of_any_type(spark, kind):
    rng = random.Random(3)
    values = [rng.choice([7, 7, rng.randrange(1000)]) for _ in range(700)]
    df = spark.createDataFrame([(i, None if i % 50 == 49 else v) for i, v in enumerate(values)], "_row bigint, n bigint")
    # numbers that a double can't tell apart, not-a-number, and equal beginnings of texts
    made = {
        "bigint": F.col("n") + F.lit(1 << 60),
        "double": F.when(F.col("n") > 900, F.lit(float("nan"))).otherwise(F.col("n") / 7),
        "string": F.concat(F.lit("the same é "), F.lpad(F.col("n").cast("string"), 4, "0")),
        "timestamp": F.timestamp_micros(F.col("n")),
        "decimal(20,3)": (F.col("n") / 8).cast("decimal(20,3)"),
    }[kind]
    df = df.withColumn("v", made.cast(kind)).repartition(3)
    known = [(min(v, 901) if kind == "double" else v, i) for i, v in enumerate(values) if i % 50 != 49]
    missing = [i for i in range(700) if i % 50 == 49]
    for n in (1, 333, len(known) + 3):
        for down in (False, True):
            order = [i for _, i in sorted(known, key=lambda x: (-x[0] if down else x[0], x[1]))] + missing
            for border in (40, 100_000):
                got = {r["_row"] for r in first_rows(df, n, "v", descending=down, border=border).collect()}
                assert got == set(order[:n]), (n, down, border)


def test_selection_is_a_filter(spark):
    df = spark.range(3000).select(F.col("id").alias("_row"), (F.col("id") % 991).cast("double").alias("v"))
    plan = first_rows(df, 100, "v", border=50)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_missing_angles_have_no_rank(spark):
    data = [(i, random.Random(i).random() * 360, random.Random(-i).random() * 180, float(i % 37), 1 + i % 2) for i in range(260)]
    df = spark.createDataFrame([(i, None if i < 30 else r, None if 200 < i < 231 else t, s, h) for i, r, t, s, h in data], "_row bigint, rot double, tilt double, score double, subset int")
    got = {r["_row"]: r["rank"] for r in ranking.equalised_rank(df, 30, half="subset").collect()}
    gone = {i for i in range(260) if i < 30 or 200 < i < 231}
    assert len(got) == 260 and {i for i, r in got.items() if r is None} == gone
    alone = {r["_row"]: r["rank"] for r in ranking.equalised_rank(df.filter("rot is not null and tilt is not null"), 30, half="subset").collect()}
    assert alone == {i: r for i, r in got.items() if r is not None}
    chosen = {r["_row"] for r in ranking.select_ranked(ranking.equalised_rank(df, 30), 20, by="rank").collect()}
    assert len(chosen) == 20 and not chosen & gone


def test_many_views_in_little_memory():
    import tracemalloc

    views._candidates.cache_clear()
    tracemalloc.start()
    table = views._candidates(7846, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    # in each cell, whatever is nearest to an angle inside is among the candidates
    at = views._points(*np.array(views.even_views(7846)).T, True)
    rng = np.random.default_rng(1)
    for _ in range(300):
        rot, tilt = rng.uniform(0, 360, 2)
        row = int(rot // views.CELL) * (360 // views.CELL) + int(tilt // views.CELL)
        near = ((at - views._points(np.array([rot]), np.array([tilt]), True)) ** 2).sum(1).argmin()
        assert near in [v["view"] for v in table["_views"][row].as_py()]
