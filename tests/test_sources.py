import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.operators import arrays
from motes.sources import acquisition, block_files, blocks, lines, logs, stacks

TABLE = """# a comment
data_optics

loop_
_rlnOpticsGroup #1
_rlnOpticsGroupName #2
1 first
2   second

data_general
_rlnTomoName   T1
_rlnNote  some words here
_rlnTomoName   T2

data_particles

loop_
# between labels
_rlnImageName #1
_rlnAngleRot #2
_rlnClassNumber #3
000001@a.mrcs   1.5  3
# a comment between rows

000002@a.mrcs   ?  4.0
000003@b.mrcs   bad  x
"""


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def save(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_lines_keep_their_order_over_splits(spark, tmp_path, small_splits):
    for name in ("a.txt", "b.txt"):
        save(tmp_path, name, "".join(f"{name} {i}\n" for i in range(200)))
    table = lines.line_table(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 10
    for name in ("a.txt", "b.txt"):
        got = [(r["at"], r["text"]) for r in table.filter(F.col("file").endswith(name)).orderBy("at").collect()]
        assert got == [(i, f"{name} {i}") for i in range(200)]


@pytest.mark.parametrize("split", [True, False])
def test_loop_blocks(spark, tmp_path, split, request):
    if split:
        request.getfixturevalue("small_splits")
    path = save(tmp_path, "t.star", TABLE)
    types = {"_rlnAngleRot": "double", "_rlnClassNumber": "int"}
    got = blocks.read_loop(spark, path, "particles", types=types).orderBy("_row").collect()
    assert [(r["_row"], r["_rlnImageName"], r["_rlnAngleRot"], r["_rlnClassNumber"]) for r in got] == [
        (0, "000001@a.mrcs", 1.5, 3), (1, "000002@a.mrcs", None, 4), (2, "000003@b.mrcs", None, None)
    ]
    assert blocks.read_loop(spark, path, "optics").count() == 2
    assert blocks.read_loop(spark, path, "particles", columns=["_rlnClassNumber"]).columns == ["_file", "_row", "_rlnClassNumber"]
    pairs = {r["key"]: r["value"] for r in blocks.read_pairs(spark, path).collect()}
    assert pairs == {"_rlnTomoName": "T2", "_rlnNote": "some words here"}
    catalog = [(r["block"], r["kind"], r["n_cols"], r["n_rows"], r["version"]) for r in blocks.block_catalog(spark, path).orderBy("block_no").collect()]
    assert catalog == [("optics", "loop", 2, 2, "3.1"), ("general", "pairs", 0, 3, "3.1"), ("particles", "loop", 3, 3, "3.1")]
    with pytest.raises(ValueError):
        blocks.read_loop(spark, path, "absent")


def test_files_may_order_columns_differently(spark, tmp_path):
    save(tmp_path, "a.star", "data_\nloop_\n_x #1\n_y #2\n1 2\n")
    save(tmp_path, "b.star", "data_\nloop_\n_y #1\n_z #2\n3 4\n")
    got = {(r["_x"], r["_y"], r["_z"]) for r in blocks.read_loop(spark, str(tmp_path), "").collect()}
    assert got == {("1", "2", None), (None, "3", "4")}
    assert {r["version"] for r in blocks.block_catalog(spark, str(tmp_path)).collect()} == {"3.0"}


def test_write_and_read_again(spark, tmp_path):
    rows = [(i, f"{i:06d}@s t.mrcs" if i % 2 else "", i / 3 if i % 5 else float("nan"), i % 3 == 0, None if i == 4 else i) for i in range(50)]
    df = spark.createDataFrame(rows, "_row bigint, _name string, _v double, _flag boolean, _n int").repartition(7)
    path = str(tmp_path / "out")
    blocks.write_loop(df, path)
    parts = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert all(p.startswith("data_particles\n\nloop_\n_name #1\n_v #2\n") for p in parts if p)
    back = [r for r in blocks.read_loop(spark, path, types={"_v": "double", "_n": "int"}).orderBy(F.col("_n").asc_nulls_first()).collect()]
    assert len(back) == 50
    by_n = {r["_n"]: r for r in back}
    with pytest.raises(ValueError):
        blocks.write_loop(df.withColumnRenamed("_v", "v"), path)
    assert by_n[None]["_flag"] == "0" and by_n[3]["_flag"] == "1"
    assert by_n[7]["_name"] == "000007@s_t.mrcs" and by_n[8]["_name"] == "?"
    assert by_n[7]["_v"] == pytest.approx(7 / 3, abs=1e-6) and by_n[5]["_v"] is None


def stack(path, data, mode, extra=0, mx=None):
    nz, ny, nx = data.shape
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, nx, ny, nz, mode)
    struct.pack_into("<3i", head, 28, *(mx or (nx, ny, nz)))
    struct.pack_into("<3f", head, 40, nx * 1.5, ny * 1.5, nz * 1.5)
    struct.pack_into("<i", head, 92, extra)
    path.write_bytes(bytes(head) + b"x" * extra + data.tobytes())


@pytest.mark.parametrize("mode,kind", [(0, "int8"), (1, "int16"), (2, "float32"), (6, "uint16"), (12, "float16")])
def test_stack_slices(spark, tmp_path, monkeypatch, mode, kind):
    monkeypatch.setattr(stacks, "RANGE_BYTES", 100)  # several ranges per stack
    data = np.arange(5 * 3 * 4).reshape(5, 3, 4).astype(kind)
    stack(tmp_path / "a.mrcs", data, mode, extra=40, mx=(0, 0, 0))
    heads = stacks.stack_headers(spark, str(tmp_path))
    h = heads.first()
    assert (h["nx"], h["ny"], h["nz"], h["mode"], h["data_offset"]) == (4, 3, 5, mode, 1064)
    assert h["pixel_x"] == pytest.approx(1.5)
    slices = stacks.read_slices(heads)
    got = {r["slice"]: r["px"] for r in slices.collect()}
    assert got == {z: data[z].astype("float32").ravel().tolist() for z in range(5)}
    voxel = {(r["z"], r["y"], r["x"]): r["v"] for r in stacks.slice_voxels(slices).collect()}
    assert voxel[4, 2, 1] == float(data[4, 2, 1]) and len(voxel) == 60


def test_unknown_pixel_type(spark, tmp_path):
    stack(tmp_path / "a.mrcs", np.zeros((1, 2, 2), "float32"), 4)
    with pytest.raises(Exception, match="unsupported pixel type"):
        stacks.read_slices(stacks.stack_headers(spark, str(tmp_path))).collect()


def test_structured_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stacks, "RANGE_BYTES", 64)
    kind = np.dtype([("blob/path", "S20"), ("blob/idx", "<u4"), ("alignments3D/pose", "<f4", (3,))])
    data = np.array([(f"J1/s{i}.mrc".encode(), i, (i, 0.5, -i)) for i in range(9)], kind)
    np.save(tmp_path / "a.npy", data)
    df = stacks.read_structured(spark, str(tmp_path), {"blob/path": "string", "blob/idx": "bigint", "alignments3D/pose": "array<double>"})
    got = [(r["_row"], r["blob/path"], r["blob/idx"], r["alignments3D/pose"]) for r in df.orderBy("_row").collect()]
    assert got == [(i, f"J1/s{i}.mrc", i, [float(i), 0.5, float(-i)]) for i in range(9)]


def test_acquisition_notes(spark, tmp_path):
    path = save(tmp_path, "a.mdoc", "PixelSpacing = 2.5\n[T = made = by hand]\nTiltAxis = 3\n[ZValue = 0]\nTiltAngle = -10\n[ZValue = 1]\nTiltAngle = 5\nTiltAngle = 10\n[Other]\nK = v = w\n")
    got = {(r["z"], r["key"]): r["value"] for r in acquisition.read_acquisition(spark, path).collect()}
    assert got[0, "TiltAngle"] == "-10" and got[1, "TiltAngle"] == "10" and got[None, "K"] == "v = w" and got[None, "PixelSpacing"] == "2.5"


def test_command_files(spark, tmp_path):
    path = save(tmp_path, "t.com", "$tilt -StandardInput\n# note\nTHICKNESS 100\nEXCLUDELIST 1,2\nTHICKNESS   200\nFLAG\n")
    assert {r["key"]: r["value"] for r in acquisition.read_commands(spark, path).collect()} == {"THICKNESS": "200", "EXCLUDELIST": "1,2", "FLAG": ""}


def test_defocus_notes(spark, tmp_path):
    save(tmp_path, "flags.defocus", "1 0 0. 0. 0 3\n1 2 -10 -8 2500 2600 12.5\n3 3 -6 -6 2400 2500 13 90\nbroken\n")
    save(tmp_path, "plain.defocus", "1 1 -10 -10 3000\nx 1 2 3 4\n")
    rows = acquisition.read_defocus(spark, str(tmp_path)).collect()
    got = sorted((r["file"].rsplit("/", 1)[1][:5], r["view_start"], r["defocus_u"], r["defocus_v"], r["astig_angle"], r["phase_shift"]) for r in rows)
    assert got == [("flags", 1, 2500.0, 2600.0, 12.5, 0.0), ("flags", 3, 2400.0, 2500.0, 13.0, 90.0), ("plain", 1, 3000.0, 3000.0, 0.0, 0.0)]


@pytest.mark.parametrize("text", ["X,Y,Z\n8,9,4\n", "z;n;y;x\n4;1;9;8\n", "index,axis-0,axis-1,axis-2\n0,4,9,8\n", "a b c\n8 9 4\n"])
def test_pick_layouts(spark, tmp_path, text):
    r = acquisition.read_picks(spark, save(tmp_path, "p.csv", text)).first()
    assert (r["x"], r["y"], r["z"]) == (8.0, 9.0, 4.0)


def test_pick_points(spark, tmp_path):
    r = acquisition.read_picks(spark, save(tmp_path, "p.txt", "  8.5   4 9\n"), "points", "xzy").first()
    assert (r["x"], r["y"], r["z"]) == (8.5, 9.0, 4.0)


def test_broken_event_lines(spark, tmp_path):
    path = save(tmp_path, "e.ndjson", '{"event": "session_start"}\nnot json\n{"event": "step_start", "step": "03_score"}\n{"event": "step_e')
    assert sorted(r["event"] for r in logs.read_events(spark, path).collect()) == ["session_start", "step_start"]
    r = logs.count_malformed(spark, path).first()
    assert (r["events"], r["malformed"]) == (2, 2)


def test_structured_array_with_a_long_header(spark, tmp_path):
    from motes.sources.stacks import read_structured

    names = ["first", *[f"a_field_with_a_rather_long_name_{i:05d}" for i in range(2000)]]
    array = np.zeros(3, [(n, "<f4") for n in names])
    array["first"] = [1, 2, 3]
    np.save(tmp_path / "long.npy", array)
    assert [r["first"] for r in read_structured(spark, str(tmp_path), {"first": "double"}).orderBy("_row").collect()] == [1.0, 2.0, 3.0]


def plain_blocks(text):
    """The rows of the loops of a text: block name -> (labels, rows), read line by line."""
    blocks_, block, in_head = [], None, False
    for line in text.replace("\r", "\n").split("\n"):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if words[0].startswith("data_"):
            block = {"name": " ".join(words)[5:].strip(), "loop": False, "labels": [], "rows": [], "keys": 0}
            blocks_.append(block)
        elif block is None:
            continue
        elif words == ["loop_"]:
            block.update(loop=True, labels=[], rows=[])
            in_head = True
        elif block["loop"] and in_head and words[0].startswith("_"):
            block["labels"].append(words[0])
        elif block["loop"]:
            in_head = False
            block["rows"].append(words)
        elif words[0].startswith("_"):
            block["keys"] += 1
    return blocks_


WEIRD = "x before\n_y 1\n" + TABLE + """data_odd
_a 1
loop_
_p #1
_q #2
1 2
_under 5
loop_
_r
_s
  _u 7
9
\t8   7  6
data_empty
loop_
_only #1
data_last
""" + "".join(f"_k{i} v\r\n" for i in (1, 2, 3)) + "data_particles\rloop_\r_rlnImageName\r" + "".join(f"{i:06d}@z.mrcs\n" for i in range(40)) + "é" * 100


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_ranges_of_any_size_give_the_same_blocks(tmp_path, size):
    path = "file://" + save(tmp_path, "w.star", WEIRD)
    data = WEIRD.encode()
    lines_ = [b"".join(d for _, d in block_files.whole_lines(path, a, min(a + size, len(data)), chunk=11)) for a in range(0, len(data), size)]
    assert b"".join(lines_) == data.replace(b"\r", b"\n")
    found = block_files.blocks_of([(path, block_files.scan(path, a, min(a + size, len(data)), chunk=13)) for a in range(0, len(data), size)])
    want = plain_blocks(WEIRD)
    assert [(b.name, b.loop, list(b.labels), b.rows) for b in found] == [(b["name"], b["loop"], b["labels"], len(b["rows"]) if b["loop"] else b["keys"]) for b in want]
    for b, w in zip(found, want, strict=True):
        if b.loop:
            read = [line.split() for start, end, _ in b.spans for _, d in block_files.whole_lines(path, start, end) for line in d.decode().split("\n")]
            assert [r for r in read if r and not r[0].startswith("#")] == w["rows"]


def test_blocks_over_range_edges(spark, tmp_path, small_splits, monkeypatch):
    path = save(tmp_path, "w.star", WEIRD)
    monkeypatch.setattr(block_files, "SMALLEST", 1)
    files = blocks.BlockFiles(spark, path)
    rows = files.loop("particles", columns=["_rlnImageName", "_rlnClassNumber", "_absent"]).orderBy("_row").collect()
    want = [r for b in plain_blocks(WEIRD) if b["name"] == "particles" for r in b["rows"]]
    assert [r["_rlnImageName"] for r in rows] == [w[0] for w in want] and [r["_row"] for r in rows] == list(range(len(want)))
    assert rows[0]["_rlnClassNumber"] == "3" and rows[-1]["_rlnClassNumber"] is None and {r["_absent"] for r in rows} == {None}
    assert {(r["block"], r["key"]) for r in files.pairs().collect()} == {("general", "_rlnTomoName"), ("general", "_rlnNote"), ("last", "_k1"), ("last", "_k2"), ("last", "_k3")}
    plan = files.loop("particles")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_files_are_listed_like_tables(tmp_path):
    for name in ("a/x.star", "a/_hidden", "a/.crc", "b/x.star", "k=1/x.star", "b/deep/y.star"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    short = lambda p: [x.split(str(tmp_path))[1] for x, _ in block_files.list_paths([f"{tmp_path}{p}"])]
    assert short("") == ["/a/x.star", "/b/x.star", "/b/deep/y.star", "/k=1/x.star"]
    assert short("/*/x.star") == ["/a/x.star", "/b/x.star", "/k=1/x.star"]
    assert short("/{a,k=?}") == ["/a/x.star", "/k=1/x.star"]
    assert short("/[b-c]") == ["/b/x.star", "/b/deep/y.star"]
    with pytest.raises(FileNotFoundError):
        block_files.list_paths([f"{tmp_path}/none"])


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    path = tmp_path / "out"
    df = spark.range(1000).select(F.col("id").alias("_row"), F.when(F.col("id") == 700, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("_v"))
    with pytest.raises(Exception, match="no"):
        blocks.write_loop(df, str(path))
    assert not [p for p in path.rglob("*") if p.is_file()]
    blocks.write_loop(df.filter("_row < 700"), str(path / "good"))
    names = sorted(p.name for p in (path / "good").iterdir())
    parts = json.loads((path / "good" / "_manifest.json").read_text())
    assert names == ["_manifest.json", *parts["parts"]] and sum(parts["rows"]) == 700
    with pytest.raises(Exception, match="exists"):
        blocks.write_loop(df.filter("_row < 700"), str(path / "good"))
    # a part that the manifest does not name was never committed
    (path / "good" / "part-999999.star").write_text("data_particles\nloop_\n_v\n5\n")
    assert blocks.read_loop(spark, str(path / "good")).count() == 700
    blocks.write_loop(df.limit(0), str(path / "none"))
    assert blocks.read_loop(spark, str(path / "none")).columns == ["_file", "_row", "_v"] and blocks.read_loop(spark, str(path / "none")).count() == 0


def array_rows(spark, **changes):
    row = {
        "_row": 0, "blob/path": ">>J1/extract/a.mrc", "blob/idx": 4, "blob/shape": [64, 32], "blob/psize_A": 1.5, "ctf/accel_kv": 300.0, "ctf/cs_mm": 2.7, "ctf/amp_contrast": 0.1,
        "ctf/df1_A": 1.0, "ctf/df2_A": 2.0, "ctf/df_angle_rad": math.pi / 2, "ctf/phase_shift_rad": 0.0, "ctf/bfactor": 0.0, "alignments3D/pose": [0.0, math.pi / 3, 0.0],
        "alignments3D/shift": [2.0, -4.0], "alignments3D/psize_A": 3.0, "alignments3D/split": 1,
    } | changes
    kinds = {"_row": "bigint", "blob/path": "string", "blob/idx": "int", "blob/shape": "array<int>", "alignments3D/pose": "array<double>", "alignments3D/shift": "array<double>", "alignments3D/split": "int"}
    kept = {k: v for k, v in row.items() if v != "absent"}
    return spark.createDataFrame([tuple(kept.values())], ", ".join(f"`{k}` {kinds.get(k, 'double')}" for k in kept))


def test_array_to_particles(spark):
    optics, particles = arrays.particles_from_array(array_rows(spark))
    p = particles.first()
    assert p["_rlnImageName"] == "000005@J1/extract/a.mrc" and (p["_rlnRandomSubset"], p["_rlnClassNumber"], p["_rlnOpticsGroup"]) == (2, 1, 1)
    assert [p[c] for c in ("_rlnAngleRot", "_rlnAngleTilt", "_rlnAnglePsi", "_rlnOriginXAngst", "_rlnOriginYAngst", "_rlnDefocusAngle")] == pytest.approx([0, 60, 0, 6, -12, 90])
    assert (optics.first()["_rlnImageSize"], optics.first()["_rlnImagePixelSize"]) == (32, 1.5)


@pytest.mark.parametrize("gone,origin", [((), 6.0), (("alignments3D/psize_A",), 3.0), (("alignments3D/psize_A", "blob/psize_A"), 8.0)])
def test_pixel_sizes_fall_back(spark, gone, origin):
    for absent in ("absent", None):
        df = array_rows(spark, **{"location/micrograph_psize_A": 4.0}, **dict.fromkeys(gone, absent))
        assert arrays.shift_origins(df).first()["_rlnOriginXAngst"] == origin


def test_arrays_without_a_pixel_size(spark):
    none = dict.fromkeys(("alignments3D/psize_A", "blob/psize_A"), "absent")
    for zero in (True, False):
        with pytest.raises(ValueError, match="pixel size"):
            arrays.shift_origins(array_rows(spark, **none), zero)
        with pytest.raises(Exception, match="none of alignments3D/psize_A"):
            arrays.shift_origins(array_rows(spark, **dict.fromkeys(none, None)), zero).select("_row").collect()


@pytest.mark.parametrize("field", ["alignments3D/pose", "alignments3D/shift"])
def test_missing_poses_and_shifts(spark, field):
    with pytest.raises(ValueError, match="missing_to_zero"):
        arrays.particles_from_array(array_rows(spark, **{field: "absent"}))
    with pytest.raises(Exception, match="missing_to_zero"):
        arrays.particles_from_array(array_rows(spark, **{field: None}))[1].select("_rlnImageName").collect()
    for absent in ("absent", None):
        p = arrays.particles_from_array(array_rows(spark, **{field: absent}), missing_to_zero=True)[1].first()
        zero = ["_rlnAngleRot", "_rlnAngleTilt", "_rlnAnglePsi"] if "pose" in field else ["_rlnOriginXAngst", "_rlnOriginYAngst"]
        assert [p[c] for c in zero] == [0.0] * len(zero) and p["_rlnDefocusV"] == 2.0
    with pytest.raises(Exception, match="3 numbers"):
        arrays.pose_columns(array_rows(spark, **{"alignments3D/pose": [1.0]})).collect()


def test_a_task_holds_little_text_at_once(tmp_path):
    path = tmp_path / "long.star"
    path.write_bytes(b"data_particles\n\nloop_\n_a #1\n" + b"%099d\n" % 7 * 60_000)
    sizes = [len(data) for _, data in block_files.whole_lines(str(path), 0, path.stat().st_size)]
    assert sum(sizes) == path.stat().st_size and max(sizes) <= 2 << 20
