import random

import pytest
from pyspark.sql import functions as F

from motes.operators import matching, tables
from motes.operators.history import iteration_history
from motes.operators.summaries import best_class, difference_statistics, first_of_key


def mapping(spark, rows):
    return spark.createDataFrame(rows, "image string, source string")


MAP = [("000001@stack.mrcs", "009619@orig.mrc"), ("000002@stack.mrcs", "000120@orig.mrc"), ("000003@stack.mrcs", "000777@other.mrc")]


def test_back_map_does_not_depend_on_order(spark):
    processed = spark.createDataFrame([(0, "000003@stack.mrcs", 1.0), (1, "000001@stack.mrcs", 2.0)], "_row bigint, image string, rot double")
    out = matching.back_map(processed, mapping(spark, MAP), "image", "source", audit="was")
    got = {r["_row"]: (r["image"], r["was"], r["rot"]) for r in out.collect()}
    assert got == {0: ("000777@other.mrc", "000003@stack.mrcs", 1.0), 1: ("009619@orig.mrc", "000001@stack.mrcs", 2.0)}


def test_back_map_missing_keys(spark):
    processed = spark.createDataFrame([(0, "000009@stack.mrcs"), (1, "000001@stack.mrcs")], "_row bigint, image string")
    with pytest.raises(Exception, match="no source"):
        matching.back_map(processed, mapping(spark, MAP), "image", "source").select("_row").collect()
    out = matching.back_map(processed, mapping(spark, MAP), "image", "source", strict=False)
    assert {r["image"] for r in out.collect()} == {"000009@stack.mrcs", "009619@orig.mrc"}
    report = matching.back_map_report(processed, mapping(spark, MAP), "image", "source").first()
    assert (report["n_processed"], report["n_mapped"], report["n_missing"], report["n_mapping_rows"]) == (2, 1, 1, 3)


def test_back_map_repeated_keys(spark):
    processed = spark.createDataFrame([(0, "000001@stack.mrcs")], "_row bigint, image string")
    same = mapping(spark, [*MAP, MAP[0]])
    assert matching.back_map(processed, same, "image", "source").first()["image"] == "009619@orig.mrc"
    assert matching.back_map_report(processed, same, "image", "source").first()["n_repeated"] == 1
    with pytest.raises(Exception, match="more than one source"):
        matching.back_map(processed, mapping(spark, [*MAP, (MAP[0][0], "1@else.mrc")]), "image", "source").select("_row").collect()


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_rounded_match_is_greedy_and_one_to_one(spark, chunk):
    rng = random.Random(4)
    pick = lambda: 7.2 if rng.random() < 0.34 else rng.uniform(0, 9)
    template = [(i, pick(), pick()) for i in range(150)]
    images = [(i, f"img{i}", pick(), pick()) for i in range(120)]
    t = spark.createDataFrame(template, "_row bigint, a double, b double")
    im = spark.createDataFrame(images, "_row bigint, image string, a double, b double")
    got = {r["_row"]: r["matched_image"] for r in matching.match_rounded(t, im, ["a", "b"], chunk=chunk).collect()}
    used, want = set(), {}
    near = lambda v: int(v + 0.5)
    for row, a, b in template:
        for i, name, c, d in images:
            if i not in used and (near(a), near(b)) == (near(c), near(d)):
                used.add(i)
                want[row] = name
                break
    assert got == want


def test_override_uses_each_update_once(spark):
    a = spark.createDataFrame([(0, "x", 1.0), (1, "x", 2.0), (2, "x", 3.0), (3, "y", 4.0)], "_row bigint, image string, v double")
    b = spark.createDataFrame([(5, "x", 10.0), (9, "x", 20.0), (7, "z", 30.0)], "_row bigint, image string, v double")
    got = {r["_row"]: (r["v"], r["updated"]) for r in matching.override_rows(a, b, ["image"], chunk=2).collect()}
    assert got == {0: (10.0, True), 1: (20.0, True), 2: (3.0, False), 3: (4.0, False)}


def test_micrographs_are_found_inside_names(spark):
    mics = [(4, "raw/foo_12.mrc"), (1, "raw/foo-1.mrc"), (2, "other/bar.mrc")]
    parts = [(0, "x/A_foo_12_p.mrcs"), (1, "foo.1.star"), (2, "nothing.mrc"), (3, "bar")]
    simple = lambda s: (lambda b: b[: b.rfind(".")] if "." in b else b)(s.rsplit("/", 1)[-1]).translate(str.maketrans("", "", "._-"))
    want = {}
    for row, name in parts:
        hits = [r for r, m in mics if simple(m) in simple(name)]
        want[row] = min(hits) if hits else None
    p = spark.createDataFrame(parts, "_row bigint, mic string")
    m = spark.createDataFrame(mics, "_row bigint, mic string")
    for batch in (1, 2, 200_000):
        assert {r["_row"]: r["mic_row"] for r in matching.assign_micrographs(p, m, batch=batch).collect()} == want
    # a name that is empty when simplified is part of every name; a missing one of none
    more = p.union(spark.createDataFrame([(9, None)], p.schema)), m.union(spark.createDataFrame([(3, "x/-_.mrc"), (0, None)], m.schema))
    got = {r["_row"]: r["mic_row"] for r in matching.assign_micrographs(*more).collect()}
    assert got == {**{row: 3 if hit is None else min(hit, 3) for row, hit in want.items()}, 9: None}
    assert matching.assign_micrographs(p, m.limit(0)).filter("mic_row is not null").count() == 0


@pytest.mark.parametrize(
    "stack,mode,root,beside,want",
    [
        ("a/s.mrcs", "root", "/data/", None, "/data/a/s.mrcs"),
        ("a/s.mrcs", "root", None, None, "a/s.mrcs"),
        ("./a//s.mrcs", "as_is", "/data", "/star", "a/s.mrcs"),
        ("a/s.mrcs", "beside", None, "/star", "/star/a/s.mrcs"),
        ("/abs/s.mrcs", "root", "/data", None, "/abs/s.mrcs"),
        ("a/s.mrcs", "auto", "/data", "/star", "/star/a/s.mrcs"),
        ("b/s.mrcs", "auto", "/data", "/star", "/data/b/s.mrcs"),
        ("/abs/s.mrcs", "auto", "/data", "/star", "/abs/s.mrcs"),
    ],
)
def test_resolve_paths(spark, stack, mode, root, beside, want):
    stacks = spark.createDataFrame([(stack,)], "stack string")
    files = spark.createDataFrame([("/star/a/s.mrcs",)], "path string")
    assert matching.resolve_paths(stacks, files, root, beside, mode).first()["resolved"] == want


def test_unknown_path_mode(spark):
    with pytest.raises(ValueError):
        matching.resolve_paths(spark.createDataFrame([("a",)], "stack string"), spark.createDataFrame([], "path string"), None, None, "nowhere")


def test_optics_must_be_unique_and_complete(spark):
    p = spark.createDataFrame([(0, 1), (1, 2)], "_row bigint, og int")
    one = spark.createDataFrame([(1, 300.0), (2, 200.0)], "og int, kv double")
    assert matching.with_checked_optics(p, one, "og").count() == 2
    with pytest.raises(Exception, match="more than once"):
        matching.with_checked_optics(p, one.union(one), "og").count()
    with pytest.raises(Exception, match="no optics group"):
        matching.with_checked_optics(p, one.filter("og = 1"), "og").count()


def test_array_update_needs_a_match(spark):
    p = spark.createDataFrame([(0, 5, 1.0)], "_row bigint, idx int, v double")
    arr = spark.createDataFrame([(0, 6, 2.0), (1, 5, 3.0), (2, 5, 4.0)], "_row bigint, idx int, v double")
    assert matching.update_from_array(p, arr, ["idx"], ["v"]).first()["v"] == 3.0
    assert matching.update_from_array(p, arr, None, ["v"]).first()["v"] == 2.0
    with pytest.raises(ValueError):
        matching.update_from_array(p, arr.filter("idx = 6"), ["idx"], ["v"])


@pytest.mark.parametrize("stability", [True, False])
def test_history_step_by_step(spark, stability):
    rng = random.Random(8)
    data = [(s, i * 2, rng.randrange(3), float(rng.randrange(12))) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(data, "session string, iteration bigint, n int, metric double")
    got = {(r["session"], r["iteration"]): (r["improved"] is True, r["not_improved"], r["best"]) for r in iteration_history(df, stability=stability, chunk=9).collect()}
    want = {}
    for s in ("a", "b"):
        best = prev = None
        stalled = 0
        for _, it, n, metric in [d for d in data if d[0] == s]:
            if best is None:
                improved, stalled = False, 0
            else:
                improved = metric < best
                stalled = 0 if (n != prev if stability else improved) else stalled + 1
            best = metric if best is None else min(best, metric)
            prev = n
            want[s, it] = (improved, stalled, best)
    assert got == want


def test_best_class_skips_missing_scores(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 0.1, 0.1), (1, nan, 0.2), (2, -1.0, 0.0), (3, None, nan), (4, 0.3, 0.1)], "_row bigint, s_class2 double, s_class11 double")
    assert [r["class"] for r in best_class(df).orderBy("_row").collect()] == [2, 11, -1, -1, 2]


def test_first_of_key_and_unequal_tables(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, None, "y"), (5, None, "z")], "_row bigint, k string, v string")
    assert {(r["_row"], r["k"], r["v"]) for r in first_of_key(df, ["k"]).collect()} == {(1, "a", "x"), (2, None, "y")}
    with pytest.raises(Exception, match="one table only"):
        tables.set_by_row(df, df.filter("_row = 1"), ["v"]).count()
    with pytest.raises(ValueError):
        tables.contiguous_blocks(df, 9)
    posed = df.select("_row", F.lit(1).alias("subset"), *[F.lit(0.0).alias(c) for c in ("rot", "tilt", "psi", "x", "y")])
    with pytest.raises(Exception, match="one table only"):
        difference_statistics(posed, posed.filter("_row = 1")).collect()


def test_overlapping_ranges(spark):
    df = spark.createDataFrame([(0, 1, 3, 10.0), (1, 3, 4, 20.0), (2, 9, 8, 30.0)], "entry int, vs int, ve int, d double")
    got = {r["index"]: r["d"] for r in matching.expand_ranges(df.withColumn("f", F.lit("f")), "vs", "ve", ["f"], "entry", ["d"]).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 20.0, 4: 20.0}


def test_samples_repeat_for_the_same_seed(spark):
    df = spark.range(200).select(F.col("id").alias("_row"))
    take = lambda part, **o: {r["_row"] for r in tables.sample_rows(df.repartition(part), 40, seed=3, **o).collect()}
    assert take(1) == take(7) == take(3, border=5)
    assert len(take(1)) == 40
    halves = [r["subset"] for r in tables.random_halves(df, seed=1).collect()]
    assert set(halves) == {1, 2} and 60 < halves.count(1) < 140


def test_points_in_long_ranges(spark):
    rng = random.Random(2)
    ends = [(rng.randrange(-(10**9), 10**9), rng.choice([0, 1, 5, 1000, 10**9])) for _ in range(200)]
    entries = [(i, i % 2, a, a + n) for i, (a, n) in enumerate(ends)] + [(200, 0, 5, 3), (201, 1, None, 7)]
    points = [(i, i % 2, rng.choice([rng.randrange(-(10**9), 10**9), *ends[i % 200], sum(ends[i % 200])])) for i in range(300)] + [(300, 0, None)]
    e = spark.createDataFrame(entries, "entry int, k int, vs bigint, ve bigint").withColumn("d", F.col("entry") * 2)
    p = spark.createDataFrame(points, "id int, k int, at bigint")
    got = {r["id"]: r["d"] for r in matching.last_covering(p, "at", e, "vs", "ve", ["k"], "entry", ["d"]).collect()}
    for i, k, at in points:
        hits = [n for n, kk, a, b in entries if kk == k and None not in (at, a) and a <= at <= b]
        assert got[i] == (2 * max(hits) if hits else None)
    assert e.filter("entry < 200").select(F.max(F.size(matching._bins(F.col("vs"), F.col("ve")))).alias("n")).first()["n"] <= 60
    plan = matching.last_covering(p, "at", e, "vs", "ve", ["k"], "entry", ["d"])._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan


def test_slices_that_do_not_fit(spark):
    want = spark.createDataFrame([(0, 1, "s"), (1, 2, "s")], "_row bigint, image_no int, stack string")
    have = spark.createDataFrame([("s", 0, 2, 2, [1.0]), ("s", 1, 2, 2, [2.0])], "stack string, slice int, ny int, nx int, px array<double>")
    assert matching.gather_slices(want, have, "o").count() == 2
    with pytest.raises(Exception, match="is missing"):
        matching.gather_slices(want, have.filter("slice = 0"), "o").count()
    with pytest.raises(Exception, match="differ in size"):
        matching.gather_slices(want, have.withColumn("nx", F.col("slice")), "o").count()


def test_ranges_over_one_point_meet_it_once_a_width(spark):
    entries = spark.range(400).select(F.lit("a").alias("k"), F.col("id").alias("entry"), (F.col("id") % 7 - 3).alias("vs"), (F.lit(1 << 20) + F.col("id") % 5).alias("ve"), (F.col("id") * 2).alias("d"))
    points = spark.range(300).select("id", F.lit("a").alias("k"), (F.col("id") * 3500).alias("at"))
    out = matching.last_covering(points, "at", entries, "vs", "ve", ["k"], "entry", ["d"])
    got = {r["id"]: r["d"] for r in out.collect()}
    for i in range(300):
        hits = [n for n in range(400) if n % 7 - 3 <= i * 3500 <= (1 << 20) + n % 5]
        assert got[i] == (2 * max(hits) if hits else None)
    grouped = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert any("_level" in line.split("]")[0] and "_bin" in line.split("]")[0] for line in grouped)


def test_bins_cover_a_range_once(spark):
    rows = [(a, a + n) for a in (-70, -8, -1, 0, 1, 5, 64) for n in (0, 1, 2, 7, 8, 63, 100)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", matching._bins(F.col("a"), F.col("b")).alias("bins"))
    for r in df.collect():
        held = sorted(x for b in r["bins"] for x in range(b["bin"] << b["level"], (b["bin"] + 1) << b["level"]))
        assert held == list(range(r["a"], r["b"] + 1))
