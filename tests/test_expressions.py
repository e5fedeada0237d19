import math

import pytest
from pyspark.sql import functions as F

from motes.functions import angles, cells, keys, logs, optics
from motes.operators import tomography as tomo


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "path,options,want",
    [
        (">J1/imported/0012_name_particles.mrcs", {}, "J1/imported/0012_name_particles.mrcs"),
        ("J1\\imported\\a.mrc", {}, "J1/imported/a.mrc"),
        (">>a.mrc", {}, "a.mrc"),
        ("J1/x/12_a.mrc", {"drop_digit_prefix": True}, "J1/x/a.mrc"),
        ("J1/12_x/a.mrc", {"drop_digit_prefix": True}, "J1/12_x/a.mrc"),
        ("J1/x/a12_b.mrc", {"drop_digit_prefix": True}, "J1/x/a12_b.mrc"),
        ("J1/x/a_particles.mrc", {"drop_particles_suffix": True}, "J1/x/a.mrc"),
        ("J1/x/a_particles", {"drop_particles_suffix": True}, "J1/x/a"),
        ("J1/x/a_particles_b.mrc", {"drop_particles_suffix": True}, "J1/x/a_particles_b.mrc"),
        ("J1/x/a.mrc", {"drop_directory": True}, "a.mrc"),
        ("J1/x/a.mrc", {"new_directory": "new/"}, "new/a.mrc"),
        ("J1/x/a.mrc", {"new_directory": "new", "drop_directory": True}, "new/a.mrc"),
        ("J1/x/a.mrc", {"new_directory": ""}, "a.mrc"),
        ("J1/x/9_a_particles.mrc", {"drop_digit_prefix": True, "drop_particles_suffix": True, "drop_directory": True}, "a.mrc"),
        ("a.mrc", {"drop_directory": True}, "a.mrc"),
    ],
)
def test_clean_path(spark, path, options, want):
    assert value(spark, keys.clean_path(F.lit(path), **options)) == want


@pytest.mark.parametrize("word,want", [("True", True), ("yes", True), (" on ", True), ("1", True), ("T", True), ("no", False), ("0", False), ("", False)])
def test_true_words(spark, word, want):
    assert value(spark, keys.is_true_word(F.lit(word))) is want


def test_image_keys(spark):
    assert value(spark, keys.image_no(F.lit("12@a@b.mrc"))) == 12
    assert value(spark, keys.stack_name(F.lit("12@a@b.mrc"))) == "a@b.mrc"
    assert value(spark, keys.image_key(F.lit(12345678), F.lit("s"))) == "12345678@s"
    assert value(spark, keys.image_no(F.lit("x@a"))) is None


@pytest.mark.parametrize(
    "number,want", [(1.5, "1.5"), (2.0, "2"), (-0.0000001, "0"), (100.0, "100"), (float("nan"), "?"), (float("-inf"), "?"), (None, "?"), (1 / 3, "0.333333")]
)
def test_number_cells(spark, number, want):
    df = spark.createDataFrame([(number,)], "v double")
    assert df.select(cells.cell_text(F.col("v"), df.schema["v"].dataType)).first()[0] == want


@pytest.mark.parametrize("text,kind,want", [("?", "double", None), ("3.0", "int", 3), ("x", "int", None), ("9007199254740993", "bigint", 9007199254740993), ("1e3", "double", 1000.0)])
def test_typed_cells(spark, text, kind, want):
    assert value(spark, cells.typed(F.lit(text), kind)) == want


def test_poses(spark):
    zero = [value(spark, c) for c in angles.pose_angles(F.array(*[F.lit(0.0)] * 3), 3)]
    assert zero[1] == 0.0
    rot, tilt, psi = 40.0, 70.0, -25.0
    m = angles.matrix_from_zyz(F.lit(rot), F.lit(tilt), F.lit(psi))
    back = [value(spark, c) for c in angles.pose_angles(F.array(*m), 9)]
    # the third angle is read from the last row's first two entries
    assert back[:2] == pytest.approx([rot, tilt])
    assert back[2] == pytest.approx(math.degrees(math.atan2(math.sin(math.radians(psi)), math.cos(math.radians(psi)))))
    with pytest.raises(ValueError):
        angles.pose_angles(F.lit(0), 5)


def test_transfer_of_unusable_optics_is_one(spark):
    nan = F.lit(float("nan"))
    one = F.lit(1.0)
    for volts, bfac, ac in ((nan, one, one), (F.lit(-1.0), one, one), (one * 300, nan, one), (one * 300, one, nan)):
        assert value(spark, optics.contrast_transfer(one / 10, one / 10, volts, one * 1e4, one * 1e4, one, one * 2.7, bfac, one, ac)) == 1.0


@pytest.mark.parametrize("seconds,want", [("-5", (0, 0, 0, 0)), ("93784.9", (1, 2, 3, 4)), ("59", (0, 0, 0, 59))])
def test_elapsed(spark, seconds, want):
    r = spark.range(1).select(*[c.alias(n) for n, c in logs.elapsed_parts(F.lit(seconds)).items()]).first()
    assert tuple(r) == want


@pytest.mark.parametrize("step,want", [("01_randomize_halves", 1), ("03_score_particles_x", 2), ("05_zz", 3), ("08_get_num_particles", 4), ("99_x", None)])
def test_step_phase(spark, step, want):
    assert value(spark, logs.step_phase(F.lit(step))) == want


@pytest.mark.parametrize("number,unit,want", [(1000.0, "nm", 10000.0), (1.0, "µm", 10000.0), (10000.0, "Angstrom", 10000.0)])
def test_defocus_units(spark, number, unit, want):
    assert value(spark, tomo.defocus_to_angstrom(F.lit(number), F.lit(unit))) == want


def test_unknown_defocus_unit(spark):
    with pytest.raises(Exception, match="unknown defocus unit"):
        value(spark, tomo.defocus_to_angstrom(F.lit(1.0), F.lit("inch")))


@pytest.mark.parametrize("numbers,want", [([1, 2, 3, 99], "micrometer"), ([50, 100, 150], "nm"), ([8999, 9000], "angstrom"), ([None], "nm")])
def test_guess_unit(spark, numbers, want):
    df = spark.createDataFrame([("t", None if v is None else -float(v)) for v in numbers], "k string, defocus double")
    assert tomo.guess_defocus_unit(df, ["k"]).first()["unit"] == want


@pytest.mark.parametrize("listing,want", [("1,2,5-7", [1, 2, 5, 6, 7]), ("7-5", [5, 6, 7]), (" 3 , 4", [3]), ("", [])])
def test_exclusions(spark, listing, want):
    df = spark.createDataFrame([("t", listing, 8)], "tomo string, l string, n int")
    assert sorted(r["tilt_index"] for r in tomo.excluded_tilts(df, ["tomo"], "l", "n").collect()) == want


def test_exclusion_out_of_range(spark):
    df = spark.createDataFrame([("t", "9", 8)], "tomo string, l string, n int")
    with pytest.raises(Exception, match="bad exclusion"):
        tomo.excluded_tilts(df, ["tomo"], "l", "n").collect()


@pytest.mark.parametrize("flip", ["none", "yz", "yz_z"])
@pytest.mark.parametrize("aligned", [True, False])
def test_tilt_matrices(spark, flip, aligned):
    import numpy as np

    row = dict(tomo="t", tilt_index=1, tilt_angle=30.0, a11=1.1, a12=0.2, a21=-0.1, a22=0.9, dx=3.0, dy=-2.0, ox=41.0, oy=52.0, cx=40.0, cy=50.0, binning=2.0, thickness=60.0, shift_x=1.0, shift_y=2.0, off_x=3.0, off_y=4.0, off_z=5.0)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'tomo' else 'int' if k == 'tilt_index' else 'double'}" for k in row))
    r = tomo.tilt_matrices(df, ["tomo"], flip=flip, for_aligned=aligned).first()
    got = np.array([[r[f"m{i}{j}"] for j in range(4)] for i in range(4)])

    def shift(x, y, z):
        m = np.eye(4)
        m[:3, 3] = x, y, z
        return m

    a = np.eye(4)
    a[:2, :2] = [[1.1, 0.2], [-0.1, 0.9]]
    a[:2, 3] = 3, -2
    b = shift(41, 52, 0) @ (np.eye(4) if aligned else np.linalg.inv(a)) @ shift(-40, -50, 0)
    b[:3, :3] *= 2
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    turn = np.array([[c, -s, 0, 40], [0, 0, 1, 50], [-s, -c, 0, 0], [0, 0, 0, 1]]) @ shift(-40, 0, -50)
    flips = {"none": np.eye(4), "yz": np.eye(4)[[0, 2, 1, 3]], "yz_z": np.array([[1, 0, 0, 0], [0, 0, -1, 59], [0, 1, 0, 0], [0, 0, 0, 1]])}
    assert got == pytest.approx(b @ turn @ shift(-1, -30, -1) @ shift(2, 2, 5) @ flips[flip])


def test_storage_box(spark):
    assert [value(spark, tomo.storage_box(F.lit(r))) for r in (0.0, 1.0, 1.4, 10.0)] == [2, 2, 4, 20]


def test_unknown_axis_order():
    with pytest.raises(ValueError):
        tomo.reorder_axes([1, 2, 3], "xxz")


def test_normal_path(spark):
    from motes.functions.keys import normal_path

    want = {"/r/a/../b.mrcs": "/r/b.mrcs", "./a//b/./c": "a/b/c", "../a/..": "..", "/../a": "/a", "a/..": ".", "a/b/": "a/b/", "": ""}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r["p"]: r["n"] for r in df.select("p", normal_path(F.col("p")).alias("n")).collect()} == want
