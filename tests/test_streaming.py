import json

from pyspark.sql import functions as F

from motes.operators import quality
from motes.streaming import events as ops

SCHEMA = "seq bigint, session string, event string, ts timestamp, step string, iteration string, status string, rc int, hostname string"


def event(seq, session, kind, step=None, status=None, rc=None, host=None, minute=0):
    return {"seq": seq, "session": session, "event": kind, "ts": f"2024-01-01T00:{minute:02d}:00Z", "step": step, "iteration": "1", "status": status, "rc": rc, "hostname": host}


def write(folder, name, events, tail=""):
    (folder / name).write_text("\n".join(json.dumps(e) for e in events) + "\n" + tail)


FIRST = [
    event(1, "a", "session_start", host="n1"),
    event(2, "a", "step_start", "03_score_particles", minute=1),
    event(1, "b", "session_start"),
    event(2, "b", "session_end", status="Finished"),
    event(1, "c", "session_start"),
]
SECOND = [
    event(3, "a", "step_end", "03_score_particles", rc=0, minute=5, host="n2"),
    event(2, "c", "session_end", status="killed"),
    event(2, "a", "step_start", "03_score_particles", minute=1),  # sent again
]


def frame(spark, tmp_path, events):
    (tmp_path / "batch").mkdir(exist_ok=True)
    write(tmp_path / "batch", "e.ndjson", events)
    return spark.read.schema(SCHEMA).json(str(tmp_path / "batch"))


def test_stages(spark, tmp_path):
    got = {r["session"]: r for r in ops.stages(frame(spark, tmp_path, FIRST), F.lit("2024-01-01 00:03:00").cast("timestamp")).collect()}
    assert (got["a"]["state"], got["a"]["current_step"], got["a"]["phase"], got["a"]["step_age_s"], got["a"]["step_done"]) == ("running", "03_score_particles", 2, 120, False)
    assert got["b"]["state"] == "finished" and got["b"]["current_step"] is None
    assert got["c"]["state"] == "running" and got["c"]["phase"] == 1
    known = spark.createDataFrame([("a",), ("z",)], "session string")
    states = {r["session"]: r["state"] for r in ops.with_unstarted(ops.stages(frame(spark, tmp_path, FIRST)), known).collect()}
    assert states == {"a": "running", "z": "unstarted"}


def test_latest_host_and_pairs(spark, tmp_path):
    df = frame(spark, tmp_path, FIRST + SECOND[:2])
    assert {r["session"]: r["hostname"] for r in ops.latest_hostnames(df).collect()} == {"a": "n2"}
    pairs = ops.pair_steps(df.union(df.filter("event = 'step_start'").withColumn("seq", F.col("seq") + 10))).orderBy("seq").collect()
    assert [(r["seq"], r["result"]) for r in pairs] == [(2, "PASS"), (12, "running")]


def test_stream_continues_where_it_stopped(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    stream = lambda: ops.event_stream(spark, str(logs), SCHEMA)
    out, mark = str(tmp_path / "stages"), str(tmp_path / "mark")
    clean, seen = str(tmp_path / "clean"), str(tmp_path / "seen")
    write(logs, "1.ndjson", FIRST, tail='{"seq": 9, "sess')
    states = {r["session"]: r["state"] for r in ops.run_stages(stream(), out, mark).collect()}
    assert states == {"a": "running", "b": "finished", "c": "running"}
    assert ops.run_to_table(ops.without_repeats(stream()), clean, seen).count() == 5
    write(logs, "2.ndjson", SECOND)
    after = {r["session"]: r for r in ops.run_stages(stream(), out, mark).collect()}
    assert {s: r["state"] for s, r in after.items()} == {"a": "running", "b": "finished", "c": "aborted"}
    assert after["a"]["step_done"] and after["a"]["current_step"] == "03_score_particles"
    assert ops.run_to_table(ops.without_repeats(stream()), clean, seen).count() == 7


def test_stages_are_compacted(spark, tmp_path):
    logs, out, mark = tmp_path / "logs", tmp_path / "stages", str(tmp_path / "mark")
    logs.mkdir()
    for i in range(9):
        steps = [event(10 * i + 1, f"s{i}", "session_start"), event(10 * i + 2, "long", "step_start", f"0{i}_x", minute=i)]
        if i % 2:
            steps.append(event(10 * i + 3, f"s{i - 1}", "session_end", status="finished"))
        write(logs, f"{i}.ndjson", steps)
        got = ops.run_stages(ops.event_stream(spark, str(logs), SCHEMA), str(out), mark, compact=3)
        batch = ops.stages(spark.read.schema(SCHEMA).json(str(logs)))
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    # the last snapshot, the one before it, and what came after that; no state of sessions, ended or not
    assert ops._parts(str(out)) == ([5, 8], [6, 7, 8])
    assert not (tmp_path / "mark" / "state").exists()
    # a batch that is done again, as after a lost driver, finds what it needs
    assert sorted(r["session"] for r in ops._merged(spark, str(out), 8).collect()) == sorted(r["session"] for r in got.collect())


def test_live_steps_pair_one_to_one(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    # a step repeated three times with two ends, a step left open, an end before any watermark passes
    steps = [event(1, "a", "step_start", "x", minute=1), event(2, "a", "step_end", "x", rc=0, minute=2)]
    steps += [event(3, "a", "step_start", "x", minute=3), event(5, "a", "step_start", "x", minute=5), event(4, "a", "step_end", "x", rc=2, minute=4)]
    steps += [event(1, "b", "step_start", "x", minute=1), event(1, "c", "step_start", "y", minute=2), event(2, "c", "step_end", "y", rc=0, minute=20)]
    later = [event(9, "z", "note", minute=40), event(9, "z", "step_start", "w", minute=59)]
    out, mark = str(tmp_path / "pairs"), str(tmp_path / "mark")
    got = []
    for i, part in enumerate((steps, later, [event(2, "b", "step_end", "x", rc=0, minute=58)], [event(10, "z", "step_end", "w", rc=0, minute=59)])):
        write(logs, f"{i}.ndjson", part)
        pairs = ops.live_steps(ops.event_stream(spark, str(logs), SCHEMA), delay="5 minutes", longest="10 minutes")
        got = ops.run_to_table(pairs, out, mark)
    rows = sorted(((r.session, r.seq, r.end_seq, r.result) for r in got.collect() if r.session != "z"), key=str)
    assert [r for r in rows if r[0] == "a"] == [("a", 1, 2, "PASS"), ("a", 3, 4, "FAIL"), ("a", 5, None, "running")]
    assert ("b", 1, None, "running") in rows and ("c", 1, 2, "PASS") in rows
    batch = spark.read.schema(SCHEMA).json(str(logs))
    columns = ["session", "iteration", "step", "seq", "t_start", "t_end", "rc", "result"]
    want = ops.pair_steps(batch.filter("session IN ('a', 'c')")).select(*columns)
    assert sorted(map(str, want.collect())) == sorted(map(str, ops.latest_pairs(got).filter("session IN ('a', 'c')").select(*columns).collect()))


def test_verdict(spark):
    rows = spark.createDataFrame([("x", True), ("y", False)], "name string, good boolean")
    warn = quality.check_rows(rows, F.col("name"), F.col("good"), "warning", F.lit(""))
    assert quality.verdict(warn).first()["ok"] is True
    crit = quality.check_rows(rows, F.col("name"), F.col("good"), "critical", F.lit(""))
    r = quality.verdict(quality.all_checks(warn, crit)).first()
    assert (r["checks"], r["passed"], r["failed"], r["critical"], r["ok"]) == (4, 2, 2, 1, False)


def test_steps_share_entries_of_the_state(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out, mark = str(tmp_path / "pairs"), str(tmp_path / "mark")
    steps = [event(2 * i + k, f"s{i}", ("step_start", "step_end")[k], "x", rc=i % 2, minute=k) for i in range(120) for k in (0, 1)]
    for n, part in enumerate((steps, [event(1, "z", "step_start", "w", minute=50)], [event(2, "z", "step_start", "w", minute=51)])):
        write(logs, f"{n}.ndjson", part)
        pairs = ops.live_steps(ops.event_stream(spark, str(logs), SCHEMA), delay="5 minutes", longest="10 minutes", buckets=4)
        got = ops.run_to_table(pairs, out, mark)
        if not n:
            assert 0 < spark.read.format("statestore").load(mark).count() <= 4
    assert {(r["session"], r["result"]) for r in got.collect() if r["session"] != "z"} == {(f"s{i}", ("PASS", "FAIL")[i % 2]) for i in range(120)}
