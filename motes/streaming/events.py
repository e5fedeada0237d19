"""Live run logs with Structured Streaming.

The batch functions take an event table with ``session``, ``seq``, ``event``, ``ts``,
``step``, ``iteration``, ``status``, ``rc`` and ``hostname``; the streaming functions take
the same columns as a stream.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.functions.logs import step_phase
from motes.sources.block_files import open_path


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Events from a growing folder of log files; malformed lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def _marks(df: DataFrame) -> DataFrame:
    """What an event may say of its session, each with the event's number in front."""
    return df.select(
        "session",
        F.struct("seq", "event", "status", "step", "rc", "ts").alias("last"),
        F.when(F.col("event") == "step_start", F.struct("seq", "step", "iteration", "ts")).alias("step"),
        F.when(F.col("hostname") != "", F.struct("seq", "hostname")).alias("host"),
    )


def _newest(marks: DataFrame) -> DataFrame:
    """The newest marks per session. Mergeable, so a session with a third of all events is combined on
    every executor first, and results of parts can be merged again."""
    return marks.groupBy("session").agg(*[F.max(c).alias(c) for c in ("last", "step", "host")])


def _latest(df: DataFrame) -> DataFrame:
    """Last event, last step start and last hostname per session."""
    return _newest(_marks(df)).select("session", "last", "step", F.col("host.hostname").alias("hostname"), F.col("last.seq").alias("seq"))


def stages(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Where each session stands: running, finished or aborted, its step and the step's age."""
    return _stages(_latest(df), now)


def _stages(latest: DataFrame, now: Column | None = None) -> DataFrame:
    ended = F.col("last.event") == "session_end"
    done = (F.col("last.event") == "step_end") & (F.col("last.step") == F.col("step.step"))
    state = F.when(ended & (F.lower("last.status") == "finished"), "finished").when(ended, "aborted").otherwise("running")
    step = F.when(~ended, F.col("step.step"))
    out = {
        "state": state,
        "current_step": step,
        "current_iteration": F.when(~ended, F.col("step.iteration")),
        "step_done": ~ended & F.coalesce(done, F.lit(False)),
        "phase": F.when(~ended, F.coalesce(step_phase(F.col("step.step")), F.when(F.col("step").isNull(), F.lit(1)))),
    }
    if now is not None:
        age = F.unix_seconds(now) - F.unix_seconds(F.col("step.ts").cast("timestamp"))
        out["step_age_s"] = F.when(~ended, F.greatest(age, F.lit(0).cast("bigint")))
    return latest.select("session", "seq", *[c.alias(n) for n, c in out.items()])


def with_unstarted(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """Add known sessions that have no event yet as ``unstarted``."""
    return known.select("session").join(sessions, "session", "left").withColumn("state", F.coalesce("state", F.lit("unstarted")))


def latest_hostnames(df: DataFrame) -> DataFrame:
    return _latest(df).select("session", "hostname").filter("hostname is not null")


def pair_steps(df: DataFrame) -> DataFrame:
    """Step starts with their ends: the n-th start of a step meets the n-th end.

    A start without end is still ``running``; others are PASS for return code 0, else FAIL.
    """
    from motes.operators.ordered import position

    on = ["session", "iteration", "step"]
    starts = position(df.filter("event = 'step_start'").select(*on, "seq", F.col("ts").alias("t_start")), on, "seq", "_n")
    ends = position(df.filter("event = 'step_end'").select(*on, "seq", F.col("ts").alias("t_end"), "rc"), on, "seq", "_n").drop("seq")
    result = F.when(F.col("t_end").isNull(), "running").when(F.col("rc") == 0, "PASS").otherwise("FAIL")
    return starts.join(ends, [*on, "_n"], "left").drop("_n").withColumn("result", result)


def without_repeats(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop events sent twice; the state is kept only as long as repeats may come."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "seq"])


def live_pairs(stream: DataFrame, delay: str = "1 day", longest: str = "1 day") -> DataFrame:
    """Step starts joined with later ends of the same step within ``longest``.

    Both sides carry a watermark, so state of steps that can no longer pair is dropped.
    """
    on = ("session", "iteration", "step")
    starts = stream.filter("event = 'step_start'").select(*[F.col(c).alias(f"s_{c}") for c in on], F.col("seq").alias("start_seq"), F.col("ts").alias("t_start")).withWatermark("t_start", delay)
    ends = stream.filter("event = 'step_end'").select(*on, F.col("seq").alias("end_seq"), F.col("ts").alias("t_end"), "rc").withWatermark("t_end", delay)
    match = (F.col("t_end") >= F.col("t_start")) & (F.col("t_end") <= F.col("t_start") + F.expr(f"interval {longest}"))
    for c in on:
        match = match & (F.col(c) == F.col(f"s_{c}"))
    return starts.join(ends, match).select(*on, "start_seq", "end_seq", "t_start", "t_end", "rc")


def latest_pairs(pairs: DataFrame) -> DataFrame:
    """One row a start of ``live_steps``: its result if it has one, else ``running``."""
    known = F.max_by(F.struct("t_start", "end_seq", "t_end", "rc", "result"), F.col("result") != "running").alias("n")
    return pairs.groupBy("session", "iteration", "step", "seq").agg(known).select("session", "iteration", "step", "seq", "n.*")


PAIR = "session string, iteration string, step string, seq long, t_start long, end_seq long, t_end long, rc int, result string"


def live_steps(stream: DataFrame, delay: str = "1 day", longest: str = "1 day", buckets: int = 1024) -> DataFrame:
    """The n-th start of a step with its n-th end, as a stream: the live form of ``pair_steps``.

    Starts and ends of a step are taken by ``seq``, which grows with ``ts``, once the watermark
    (``delay`` behind the newest event) has passed them, so that none can come before them any
    more; newer events wait in the state, and events without ``seq`` or ``ts`` have no place.
    A start
    without end is given once as ``running``, when it is ``longest`` old; its place stays
    taken, and an end that comes later gives a second row with its result, under the same
    ``seq``. ``latest_pairs`` keeps the last word. An end without start waits for its start.

    Steps are dealt to ``buckets`` by hash, and a bucket is one entry of the state with one timer: calling Python once
    a step and batch would take far longer than the work itself. The number is fixed for the life of a checkpoint.
    """
    import pandas as pd

    on = ["session", "iteration", "step"]
    wait = pd.Timedelta(longest).value // 1_000_000
    names = [c.split()[0] for c in PAIR.split(", ")]

    def pair(_, batches, state):
        # of each step: waiting: not yet passed; starts: open, with whether they were given; ends: without start
        steps = {tuple(key): [[tuple(x) for x in part] for part in parts] for key, *parts in (json.loads(state.get[0]) if state.exists else [])}
        for batch in batches:
            rcs = [None if pd.isna(rc) else int(rc) for rc in batch["rc"]]
            keys = zip(*[[None if pd.isna(x) else x for x in batch[c]] for c in on])
            for key, seq, event, at, rc in zip(keys, batch["seq"].tolist(), batch["event"], batch["at"].tolist(), rcs):
                steps.setdefault(key, [[], [], []])[0].append((seq, event == "step_start", at, rc))
        now = state.getCurrentWatermarkMs()
        out, kept, due = [], [], []
        for key, (waiting, starts, ends) in steps.items():

            def give(start, end, result, key=key):
                out.append((*key, *start[:2], *(end or (None, None, None)), result))

            passed = sorted(x for x in waiting if x[2] // 1000 < now)
            waiting = [x for x in waiting if x[2] // 1000 >= now]
            for seq, starting, at, rc in passed:
                if starting:
                    starts.append((seq, at, False))
                else:
                    ends.append((seq, at, rc))
            paired = min(len(starts), len(ends))
            for start, end in zip(starts[:paired], ends[:paired]):
                give(start, end, "PASS" if end[2] == 0 else "FAIL")
            starts, ends = starts[paired:], ends[paired:]
            for i, (seq, at, given) in enumerate(starts):
                if not given and at // 1000 + wait <= now:
                    starts[i] = (seq, at, True)
                    give(starts[i], None, "running")
            if waiting or starts or ends:
                kept.append((key, waiting, starts, ends))
                due += [x[2] // 1000 + 1 for x in waiting] + [at // 1000 + wait for _, at, given in starts if not given]
        if kept:
            state.update((json.dumps(kept),))
            if due:
                state.setTimeoutTimestamp(max(min(due), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names).astype({"seq": "Int64", "t_start": "Int64", "end_seq": "Int64", "t_end": "Int64", "rc": "Int32"})

    # a start with a null key meets no end, as in ``pair_steps``
    known = " AND ".join(f"{c} IS NOT NULL" for c in on)
    steps = stream.filter(f"(event = 'step_start' OR event = 'step_end' AND {known}) AND seq IS NOT NULL AND ts IS NOT NULL")
    steps = steps.withWatermark("ts", delay).select(F.pmod(F.xxhash64(*on), F.lit(buckets)).alias("bucket"), *on, "seq", "event", "ts", F.unix_micros("ts").alias("at"), "rc")
    pairs = steps.groupBy("bucket").applyInPandasWithState(pair, PAIR, "steps string", "append", "EventTimeTimeout")
    return pairs.withColumns({c: F.timestamp_micros(c) for c in ("t_start", "t_end")})


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append everything that is there to a table, then stop; later calls continue."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _parts(path: str) -> tuple[list[int], list[int]]:
    """Numbers of the complete snapshots and of the complete updates below a path."""
    system, inner = open_path(path)
    found: dict[str, list[int]] = {"snapshot": [], "update": []}
    for entry in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        kind, _, number = entry.base_name.partition("=")
        if kind in found and system.get_file_info(f"{entry.path}/_SUCCESS").is_file:
            found[kind].append(int(number))
    return sorted(found["snapshot"]), sorted(found["update"])


def _merged(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest marks of all sessions, from the last snapshot before ``upto`` and the updates since."""
    snapshots, updates = _parts(path)
    snapshots = [s for s in snapshots if upto is None or s < upto]
    since = [u for u in updates if (not snapshots or u > snapshots[-1]) and (upto is None or u <= upto)]
    names = [f"snapshot={n}" for n in snapshots[-1:]] + [f"update={n}" for n in since]
    return _newest(spark.read.parquet(*[f"{path}/{n}" for n in names]))


def run_stages(stream: DataFrame, path: str, checkpoint: str, compact: int = 10) -> DataFrame:
    """Keep where every session stands in a table of its own, and read it.

    The stream has no state: a micro-batch writes the newest marks of the sessions in it, and every ``compact``
    batches these are merged with the last snapshot into a new one. A read scans the newest snapshot and the updates
    after it. Each batch has its own folder, replaced on a retry, and what a snapshot was made from stays until
    the next one is there, so a lost executor or a restarted query neither loses nor doubles anything.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        _newest(_marks(batch)).write.mode("overwrite").parquet(f"{path}/update={number}")
        if (number + 1) % compact:
            return
        _merged(spark, path, number).write.mode("overwrite").parquet(f"{path}/snapshot={number}")
        snapshots, updates = _parts(path)
        before = [s for s in snapshots if s < number][-1:]
        system, inner = open_path(path)
        for kind, numbers in (("snapshot", [s for s in snapshots if before and s < before[0]]), ("update", [u for u in updates if before and u <= before[0]])):
            for n in numbers:
                system.delete_dir(f"{inner}/{kind}={n}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = _merged(spark, path)
    return _stages(newest.select("session", "last", "step", F.col("host.hostname").alias("hostname"), F.col("last.seq").alias("seq")))
