"""Map, Fourier and similarity operators against direct computation."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.operators import bricks, fourier, scores, similar, voxels

RNG = np.random.default_rng(11)


def image_rows(images, ids=None):
    return [(int(i), [float(v) for v in im.ravel()]) for i, im in zip(ids or range(len(images)), images)]


def dft(a):
    """Plain double sum."""
    ny, nx = a.shape
    out = np.zeros((ny, nx), complex)
    for ky in range(ny):
        for kx in range(nx):
            out[ky, kx] = sum(a[y, x] * cmath.exp(-2j * math.pi * (ky * y / ny + kx * x / nx)) for y in range(ny) for x in range(nx))
    return out


def idft(f):
    return np.conj(dft(np.conj(f))) / f.size


def soft_ncc(a, b, w):
    ma, mb = (w * a).sum() / w.sum(), (w * b).sum() / w.sum()
    num = (w * (a - ma) * (b - mb)).sum()
    return max(0.0, num / (math.sqrt((w * (a - ma) ** 2).sum() * (w * (b - mb) ** 2).sum()) + 1e-12))


def structural(a, b, w, sigma):
    fa, fb = dft(a), dft(b)
    mean = (abs(fa) + abs(fb) + 2e-8) / 2
    a, b = idft(fa * mean / (abs(fa) + 1e-8)).real, idft(fb * mean / (abs(fb) + 1e-8)).real
    ny, nx = a.shape
    freq = lambda n: [(k if k < (n + 1) // 2 else k - n) / n for k in range(n)]
    fy, fx = np.array(freq(ny))[:, None], np.array(freq(nx))[None, :]
    g = np.exp(-2 * math.pi**2 * sigma**2 * (fx**2 + fy**2))
    out = soft_ncc(a, b, w)
    fa, fb = dft(a), dft(b)
    for h in (2j * math.pi * fx * g, 2j * math.pi * fy * g, -((2 * math.pi * fx) ** 2) * g, -((2 * math.pi * fy) ** 2) * g):
        out *= soft_ncc(idft(h * fa).real, idft(h * fb).real, w)
    return out


def test_structural_score(spark):
    ref = RNG.normal(size=(6, 5))
    images = [ref + RNG.normal(size=ref.shape) * s for s in (0.0, 0.1, 0.3, 5.0)]
    w = RNG.uniform(0.2, 1, size=ref.shape)
    rows = [(i, im.ravel().tolist(), ref.ravel().tolist(), w.ravel().tolist()) for i, im in enumerate(images)]
    df = spark.createDataFrame(rows, "id bigint, px array<double>, ref array<double>, w array<double>")
    got = {r["id"]: r["score"] for r in scores.structural_score(df, 6, 5, 1.2).collect()}
    for i, im in enumerate(images):
        assert got[i] == pytest.approx(structural(im, ref, w, 1.2), abs=1e-4)
    assert got[0] == pytest.approx(1.0, abs=1e-5) and got[1] > got[3]


@pytest.mark.parametrize("pack", [4, 16, 256])
def test_most_similar_finds_the_best_partner(spark, pack):
    base = RNG.normal(size=12)
    crowd = [base + RNG.normal(size=12) * 0.05 for _ in range(30)]  # a third of all images look alike
    others = [RNG.normal(size=12) for _ in range(60)]
    images = [*crowd, *others, np.ones(12), others[0] * 2 + 1]
    df = spark.createDataFrame(image_rows(images), "id bigint, px array<double>").repartition(5)
    got = {r["id"]: (r["similar"], r["cc"]) for r in similar.most_similar(df, [], pack=pack).collect()}
    cc = np.full((len(images), len(images)), -np.inf)
    for i, a in enumerate(images):
        for j, b in enumerate(images):
            if i != j and a.std() > 0 and b.std() > 0:
                cc[i, j] = np.corrcoef(a, b)[0, 1]
    for i in range(len(images)):
        if images[i].std() == 0:
            assert got[i] == (None, 0.0)
        else:
            assert got[i][1] == pytest.approx(cc[i].max())
            assert cc[i, got[i][0]] == pytest.approx(cc[i].max())


def test_most_similar_stays_in_its_group(spark):
    images = [RNG.normal(size=9) for _ in range(24)]
    images += [images[0], images[1] * 3]
    rows = [(i, [float(x) for x in im], i % 3) for i, im in enumerate(images)]
    df = spark.createDataFrame(rows, "id bigint, px array<double>, view int")
    got = {r["id"]: r["similar"] for r in similar.most_similar(df, ["view"], pack=3).collect()}
    for i, a in enumerate(images):
        cc = {j: np.corrcoef(a, b)[0, 1] for j, b in enumerate(images) if j != i and j % 3 == i % 3}
        assert got[i] is None or cc[got[i]] == pytest.approx(max(cc.values()))


def test_copies_point_to_each_other(spark):
    a, b = RNG.normal(size=8), RNG.normal(size=8)
    images = [b, a, a, a, a * 1.0, b + 0.01 * a]
    df = spark.createDataFrame(image_rows(images, ids=[50, 40, 9, 70, 10**15, 3]), "id bigint, px array<double>")
    got = {r["id"]: (r["similar"], round(r["cc"], 6)) for r in similar.most_similar(df, [], pack=2).collect()}
    near = round(np.corrcoef(b, b + 0.01 * a)[0, 1], 6)
    assert got == {9: (40, 1.0), 40: (9, 1.0), 70: (9, 1.0), 10**15: (9, 1.0), 50: (3, near), 3: (50, near)}


def test_correlation_matrix(spark):
    maps = RNG.normal(size=(7, 10))
    maps[3] = 2.0
    df = spark.createDataFrame(image_rows(maps), "map bigint, px array<double>")
    got = {(r["a"], r["b"]): r["cc"] for r in scores.correlation_matrix(df, pack=3).collect()}
    assert len(got) == 49
    for i in range(7):
        for j in range(7):
            want = 1.0 if i == j else 0.0 if 3 in (i, j) else np.corrcoef(maps[i], maps[j])[0, 1]
            assert got[i, j] == pytest.approx(want)


def test_special_cases_of_correlation(spark):
    rows = [("flat", i, 2.0, float(i)) for i in range(4)] + [("tiny", i, 1e-8 * i, 1e-8 * i) for i in range(4)] + [("same", i, float(i), 3.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, i int, a double, b double")
    got = {r["k"]: r["CC"] for r in scores.pair_scores(df, ["k"], ["CC"]).collect()}
    assert got["flat"] == 0.0 and got["tiny"] == 1.0 and got["same"] == pytest.approx(1.0)


@pytest.mark.parametrize("masked", [True, False])
def test_peak_signal_to_noise(spark, masked):
    a, b, w = RNG.uniform(0, 3, 20), RNG.uniform(0, 3, 20), (RNG.uniform(size=20) > 0.4).astype(float)
    df = spark.createDataFrame([(1, i, float(a[i]), float(b[i]), float(w[i])) for i in range(20)], "k int, i int, a double, b double, w double")
    got = scores.pair_scores(df, ["k"], ["PSNR"], mask="w" if masked else None, threshold=0.1).first()["PSNR"]
    if masked:
        inside = np.flatnonzero(w > 0.1)
        mse, peak = sum((a[i] - b[i]) ** 2 for i in inside[1:]) / len(inside), a[inside].max()
    else:
        mse, peak = ((a - b) ** 2).sum() / 40, max(a.max(), 0)
    assert got == pytest.approx(20 * math.log10(peak / math.sqrt(mse)))


def grid(n, re, im, extra=()):
    half = n // 2
    return [(*extra, z - half, y - half, x - half, float(re[z, y, x]), float(im[z, y, x])) for z in range(n) for y in range(n) for x in range(n)]


def test_shell_correlation_and_isotropy(spark):
    n, pixel = 6, 1.2
    a = RNG.normal(size=(2, n, n, n))
    b = a + RNG.normal(size=(2, n, n, n)) * 0.5
    schema = "m int, kz int, ky int, kx int, re double, im double"
    fa = spark.createDataFrame(grid(n, *a, extra=(1,)), schema)
    fb = spark.createDataFrame(grid(n, *b, extra=(1,)), schema)
    k = np.arange(n) - n // 2
    r2 = k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2
    ca, cb = a[0] + 1j * a[1], b[0] + 1j * b[1]
    bins = 3
    got = {r["shell"]: r for r in fourier.shell_correlation(fa, fb, ["m"], bins, n, pixel).collect()}
    for s in range(bins):
        inside = (r2 * bins**2 >= s**2 * r2.max()) & (r2 * bins**2 < (s + 1) ** 2 * r2.max())
        want = (ca[inside] * cb[inside].conj()).sum().real / math.sqrt((abs(ca[inside]) ** 2).sum() * (abs(cb[inside]) ** 2).sum())
        assert got[s]["fsc"] == pytest.approx(want)
        assert got[s]["frequency"] == pytest.approx((s + 0.5) * math.sqrt(r2.max()) / bins / (n * pixel))

    s = np.sqrt(r2) / (n * pixel)
    band = (s >= 0.2) & (s <= 0.4)
    p = abs(ca[band]) ** 2
    kz, ky, kx = np.meshgrid(k, k, k, indexing="ij")
    unit = np.stack([g[band] for g in (kx, ky, kz)]) / np.sqrt(r2[band])
    moments = (unit * p) @ unit.T / p.sum()
    iso = fourier.direction_isotropy(fa, ["m"], F.lit(0.2), F.lit(0.4), n, pixel).first()["isotropy_score"]
    assert band.sum() < 100  # too sparse, so the upper third of the spectrum counts
    upper = s >= 0.66 * 0.5 / pixel
    pu = abs(ca[upper]) ** 2
    uu = np.stack([g[upper] for g in (kx, ky, kz)]) / np.sqrt(r2[upper])
    assert iso == pytest.approx(min(1, 3 * np.linalg.eigvalsh((uu * pu) @ uu.T / pu.sum()).min()))
    exact = fourier.direction_isotropy(fa, ["m"], F.lit(0.2), F.lit(0.4), n, pixel, fallback=None).first()["isotropy_score"]
    assert exact == pytest.approx(3 * np.linalg.eigvalsh(moments).min())


def test_scatter_add(spark):
    n = 4
    re, im = RNG.normal(size=(2, n, n))
    rows = [(1, 0, y - 2, x - 2, float(re[y, x]), float(im[y, x])) for y in range(n) for x in range(n)]
    images = spark.createDataFrame(rows, "image int, kz int, ky int, kx int, re double, im double")
    poses = spark.createDataFrame([(1, 1, 31.0, 47.0, 12.0), (1, 1, 200.0, 100.0, -70.0)], "image int, half int, rot double, tilt double, psi double")
    got = {(r["iz"], r["iy"], r["ix"]): (r["re"], r["im"], r["weight"]) for r in fourier.scatter_add(images, poses, ["half"], n).collect()}

    def turn(axis, deg):
        c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) if axis == "z" else np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])

    acc = {}
    for rot, tilt, psi in ((31, 47, 12), (200, 100, -70)):
        m = turn("z", rot) @ turn("y", tilt) @ turn("z", psi)
        for y in range(n):
            for x in range(n):
                v = complex(re[y, x], im[y, x])
                p = m @ [x - 2, y - 2, 0]
                if p[0] < 0:
                    p, v = -p, v.conjugate()
                k = [int(round(c)) for c in p]
                if max(map(abs, k)) <= n // 2:
                    spot = tuple(c % n for c in k[::-1])
                    total, weight = acc.get(spot, (0, 0))
                    acc[spot] = (total + v, weight + 1)
    assert set(got) == set(acc)
    for spot, (total, weight) in acc.items():
        assert got[spot][2] == weight
        assert complex(*got[spot][:2]) == pytest.approx(total / (weight + 1e-8))


@pytest.mark.parametrize("n", [3, 4, 5, 41])
@pytest.mark.parametrize("options", [{}, {"splits": 4}])
def test_robust_statistics(spark, n, options):
    values = np.round(RNG.normal(size=n), 1)
    df = spark.createDataFrame([(1, float(v)) for v in values], "map int, v double")
    r = voxels.robust_statistics(df, ["map"], **options).first()
    s = np.sort(values)
    assert r["max"] == (s[2] if n > 4 else s[0])
    assert (r["highQuartile"], r["lowQuartile"], r["min"]) == (s[n // 4], s[3 * n // 4], s[min(n - 1, int(n * 0.925))])
    assert r["mean"] == pytest.approx(values.mean())
    assert voxels.robust_statistics(df, ["map"], median=True, **options).first()["median"] == pytest.approx(np.median(values))


def test_otsu_of_two_heaps_and_of_a_flat_map(spark):
    rows = [("two", float(v)) for v in np.r_[RNG.normal(0, 0.1, 200), RNG.normal(5, 0.1, 100)]] + [("flat", 3.0)] * 5
    df = spark.createDataFrame(rows, "map string, v double")
    got = {r["map"]: r["threshold"] for r in voxels.otsu_threshold(df, ["map"]).collect()}
    assert 0 < got["two"] < 5 and got["flat"] == 3.0


@pytest.mark.parametrize("name,want", [("subset_1_105340_locres.mrc", "105340"), ("x/best77_locinfo.mrc", "77"), ("m_12.mrc", "12"), ("plain.mrc", "plain")])
def test_map_labels(spark, name, want):
    assert spark.range(1).select(voxels.map_label(F.lit(name)).alias("v")).first()["v"] == want


def test_boxes_outside_the_volume(spark):
    vol = spark.createDataFrame([(1, z, y, x, 1.0) for z in range(3) for y in range(3) for x in range(3)], "tomo int, z int, y int, x int, v double")
    picks = spark.createDataFrame([(1, "in", 1.0, 1.0, 1.0), (1, "out", 0.0, 0.0, 0.0)], "tomo int, particle string, cz double, cy double, cx double")
    sizes = spark.createDataFrame([(1, 3, 3, 3)], "tomo int, nz int, ny int, nx int")
    total = {r["particle"]: r["s"] for r in voxels.cut_boxes(picks, vol, sizes, 2).groupBy("particle").agg(F.sum("v").alias("s")).collect()}
    assert total == {"in": 8.0, "out": 1.0}
    kept = voxels.cut_boxes(picks, vol, sizes, 2, radius=1.0, policy="skip").select("particle").distinct().collect()
    assert [r["particle"] for r in kept] == ["in"]
    with pytest.raises(Exception, match="outside its volume"):
        voxels.cut_boxes(picks, vol, sizes, 2, radius=1.0, policy="error").collect()


def test_statistics_inside_a_mask(spark):
    from motes.operators import voxels

    rows = [(m, 0, 0, x, float(x * (m + 1))) for m in range(2) for x in range(20)]
    df = spark.createDataFrame(rows, "map int, z int, y int, x int, v double")
    mask = spark.createDataFrame([(0, 0, x, 0.2 if x % 3 else 0.9) for x in range(20)], "z int, y int, x int, w double")
    got = {r["map"]: (r["n"], r["max"], r["mean"]) for r in voxels.robust_statistics(df, ["map"], mask=mask).collect()}
    kept = [x for x in range(20) if x % 3 == 0]
    assert got == {m: (len(kept), kept[2] * (m + 1.0), sum(kept) * (m + 1) / len(kept)) for m in range(2)}


@pytest.mark.parametrize("box,side", [(1, 2), (2, 2), (3, 4), (5, 16)])
def test_packed_boxes_over_brick_edges(spark, box, side):
    """Boxes inside, on edges and outside; repeated and misplaced picks; a sparse volume."""
    rng = np.random.default_rng(4)
    full = {(z, y, x): float(rng.integers(1, 99)) for z in range(7) for y in range(6) for x in range(5) if rng.random() < 0.8}
    vol = spark.createDataFrame([("a", *at, v) for at, v in full.items()] + [("b", 0, 0, 0, 5.0), ("b", 0, 0, 1, None)], "tomo string, z int, y int, x int, v double")
    centres = [(float(z), float(y), float(x)) for z, y, x in rng.integers(-3, 9, (25, 3))] + [(2.5, 2.5, 2.5)] * 2 + [(None, 1.0, 1.0)]
    picks = spark.createDataFrame([("a", i if i < 25 else 99, *c) for i, c in enumerate(centres)] + [("b", 1, 0.0, 0.0, 0.0), ("c", 1, 0.0, 0.0, 0.0)], "tomo string, particle int, cz double, cy double, cx double")
    sizes = spark.createDataFrame([("a", 7, 6, 5), ("b", 1, 1, 2)], "tomo string, nz int, ny int, nx int")
    got = sorted((r["tomo"], r["particle"], r["px"]) for r in bricks.cut_packed_boxes(picks.repartition(3), vol, sizes, box, pad_value=-1.0, side=side).collect())
    want = []
    for tomo, particle, *centre in [tuple(r) for r in picks.collect()]:
        if tomo == "c":
            continue
        known = full if tomo == "a" else {(0, 0, 0): 5.0}
        low = [None if c is None else round(c) - box // 2 for c in centre]
        cube = [(iz, iy, ix) for iz in range(box) for iy in range(box) for ix in range(box)]
        want.append((tomo, particle, [-1.0 if None in low else known.get(tuple(a + b for a, b in zip(low, i, strict=True)), -1.0) for i in cube]))
    assert got == sorted(want)


def test_a_box_is_no_wider_than_a_brick(spark):
    with pytest.raises(ValueError):
        bricks.cut_packed_boxes(spark.range(1), spark.range(1), spark.range(1), 9, side=8)


def test_packs_that_cannot_win_are_not_multiplied(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    images = [c + 0.02 * rng.normal(size=16) for c in centres for _ in range(20)]
    df = spark.createDataFrame(image_rows(images), "id bigint, px array<double>").repartition(4)
    rows = similar.most_similar(df, [], pack=10, work=True).collect()
    cc = np.corrcoef(np.array(images))
    np.fill_diagonal(cc, -1)
    assert all(r["cc"] == pytest.approx(cc[r["id"]].max()) and cc[r["id"], r["similar"]] == pytest.approx(cc[r["id"]].max()) for r in rows)
    assert sum(r["multiplied"] for r in rows) < 0.5 * len(images) ** 2


def test_pixels_are_not_shuffled_per_pair_of_packs(spark):
    rng = np.random.default_rng(4)
    images = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in im], None if i % 3 == 0 else i % 3) for i, im in enumerate(images)]
    df = spark.createDataFrame(rows, "id bigint, px array<double>, view int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for group in ([], ["view"]):
            out = similar.most_similar(df, group, pack=4)
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert "CartesianProduct" in plan and "_to" not in plan
            got = {r["id"]: r["similar"] for r in out.collect()}
            for i, a in enumerate(images):
                cc = {j: np.corrcoef(a, b)[0, 1] for j, b in enumerate(images) if j != i and (not group or j % 3 == i % 3)}
                assert cc[got[i]] == pytest.approx(max(cc.values()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_counts_weigh_in_the_best_resolution(spark, tmp_path):
    from motes.plans import catalog

    rows = [(0, [0.51] * 64, 3), (10**6, [0.5] * 64, 3)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    # 3.03 with a count of 0 against 3.00 with one of 10^8, which costs 0.1
    assert {r["count"] for r in catalog.PLANS["a15_best_count_map"](spark, str(tmp_path)).collect()} == {0}
