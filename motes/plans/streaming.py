"""Ready-made run-log queries, as batch and as streams over files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.plans.registry import query
from motes.plans.standins import EVENTS, events, table, with_
from motes.session import scratch_path
from motes.streaming import events as ops

SCHEMA = "seq bigint, session string, event string, ts timestamp, step string, iteration string, status string, rc int, hostname string"

STAGES = """l AS (SELECT session, max(seq) AS seq, arg_max(event, seq) AS event, arg_max(status, seq) AS status, arg_max(step, seq) AS step, arg_max(step, seq) FILTER (event = 'step_start') AS cs,
    arg_max(iteration, seq) FILTER (event = 'step_start') AS ci, arg_max(ts, seq) FILTER (event = 'step_start') AS st FROM ev GROUP BY 1)"""
STAGE = """SELECT session, seq, CASE WHEN event = 'session_end' THEN CASE WHEN lower(status) = 'finished' THEN 'finished' ELSE 'aborted' END ELSE 'running' END AS state,
    CASE WHEN event <> 'session_end' THEN cs END AS current_step, CASE WHEN event <> 'session_end' THEN ci END AS current_iteration, event = 'step_end' AND coalesce(step = cs, false) AS step_done,
    CAST(CASE WHEN event = 'session_end' THEN NULL WHEN cs IS NULL THEN 1 WHEN cs[1:3] IN ('04_', '05_') THEN 3 WHEN cs[1:3] IN ('06_', '07_', '08_') THEN 4 END AS INTEGER) AS phase"""


def _line():
    return F.to_json(F.struct("seq", "session", "event", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "step", "iteration", "status", "rc", "hostname"))


def _stream(spark, sf_dir, repeat=False):
    """The run log as a folder of NDJSON files, some lines broken, read as a stream."""
    path = scratch_path(spark, "stream")
    ev = events(spark, sf_dir)
    if repeat:
        ev = ev.union(ev.filter("seq % 3 = 0"))
    broken = ev.filter("seq % 100 = 0").select(F.lit('{"seq": 1, "sess').alias("value"))
    ev.select(_line().alias("value")).union(broken).repartition(4).write.text(path)
    return ops.event_stream(spark, path, SCHEMA, files_per_batch=2)


@query("t1_live_ingest", with_(EVENTS) + "SELECT seq, session, event, step, iteration, status, rc, hostname FROM ev")
def live_ingest(spark, sf_dir):
    out = ops.run_to_table(_stream(spark, sf_dir), scratch_path(spark, "ingested"), scratch_path(spark, "progress"))
    return out.drop("ts")


@query("t2_stages", with_(EVENTS, STAGES) + STAGE + ", CASE WHEN event <> 'session_end' THEN CAST(floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(st)) AS BIGINT) END AS step_age_s FROM l")
def stages(spark, sf_dir):
    return ops.stages(events(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))


@query("t2_live_stages", with_(EVENTS, STAGES) + STAGE + " FROM l")
def live_stages(spark, sf_dir):
    return ops.run_stages(_stream(spark, sf_dir), scratch_path(spark, "stages"), scratch_path(spark, "progress"))


@query(
    "t2_unstarted",
    with_(EVENTS, STAGES) + "SELECT CAST(c_custkey AS VARCHAR) AS session, coalesce(CASE WHEN event = 'session_end' THEN CASE WHEN lower(status) = 'finished' THEN 'finished' ELSE 'aborted' END WHEN event IS NOT NULL THEN 'running' END, 'unstarted') AS state FROM customer LEFT JOIN l ON session = CAST(c_custkey AS VARCHAR)",
)
def unstarted(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session"))
    return ops.with_unstarted(ops.stages(events(spark, sf_dir)), known).select("session", "state")


PAIRED = """, a AS (SELECT *, row_number() OVER (PARTITION BY session, iteration, step ORDER BY seq) AS n FROM ev WHERE event = 'step_start'),
    b AS (SELECT *, row_number() OVER (PARTITION BY session, iteration, step ORDER BY seq) AS n FROM ev WHERE event = 'step_end')
    SELECT a.session, a.iteration, a.step, a.seq, b.rc, CASE WHEN b.seq IS NULL THEN 'running' WHEN b.rc = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM a LEFT JOIN b USING (session, iteration, step, n)"""


@query("t3_pair_steps", with_(EVENTS) + PAIRED)
def pair_steps(spark, sf_dir):
    return ops.pair_steps(events(spark, sf_dir)).drop("t_start", "t_end")


@query("t3_live_steps", with_(EVENTS) + PAIRED)
def live_steps(spark, sf_dir):
    """The log as a stream that ends in two late events, so that all before them is known to be complete."""
    path, out, progress = (scratch_path(spark, n) for n in ("stream", "steps", "progress"))
    events(spark, sf_dir).select(_line().alias("value")).repartition(4).write.text(path)
    late = {"session": F.lit("~"), "event": F.lit("step_start"), "step": F.lit("~"), "iteration": F.lit("~"), "status": F.lit(""), "rc": F.lit(0), "hostname": F.lit("")}
    for number in range(3):
        if number:
            last = spark.range(1).select(F.lit(number).alias("seq"), F.make_timestamp(F.lit(2099 + number), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), *[v.alias(n) for n, v in late.items()])
            last.select(_line().alias("value")).write.mode("append").text(path)
        # files arrive in no particular order here, so nothing counts as late
        pairs = ops.live_steps(ops.event_stream(spark, path, SCHEMA), delay="60 days", longest="5 days")
        got = ops.run_to_table(pairs, out, progress)
    return ops.latest_pairs(got).filter("session <> '~'").select("session", "iteration", "step", "seq", "rc", "result")


@query(
    "t3_live_pairs",
    with_(EVENTS)
    + """SELECT a.session, a.iteration, a.step, a.seq AS start_seq, b.seq AS end_seq, b.rc FROM ev a JOIN ev b ON a.session = b.session AND a.iteration = b.iteration AND a.step = b.step
    WHERE a.event = 'step_start' AND b.event = 'step_end' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 5 DAY""",
)
def live_pairs(spark, sf_dir):
    # files arrive in no particular order here, so nothing counts as late
    pairs = ops.live_pairs(_stream(spark, sf_dir), delay="60 days", longest="5 days")
    return ops.run_to_table(pairs, scratch_path(spark, "pairs"), scratch_path(spark, "progress")).drop("t_start", "t_end")


@query("t4_hostnames", with_(EVENTS) + "SELECT session, arg_max(hostname, seq) FILTER (hostname IS NOT NULL) AS hostname FROM ev GROUP BY 1 HAVING count(hostname) > 0")
def hostnames(spark, sf_dir):
    return ops.latest_hostnames(events(spark, sf_dir))


@query("t5_without_repeats", with_(EVENTS) + "SELECT session, event, count(*) AS n FROM ev GROUP BY 1, 2")
def without_repeats(spark, sf_dir):
    clean = ops.without_repeats(_stream(spark, sf_dir, repeat=True), "60 days")
    out = ops.run_to_table(clean, scratch_path(spark, "clean"), scratch_path(spark, "progress"))
    return out.groupBy("session", "event").agg(F.count(F.lit(1)).alias("n"))
