"""Ranking and selecting particles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motes.operators.ordered import count_at_most, position, ranked, splitters
from motes.operators.selection import first_rows
from motes.operators.views import nearest_view
from motes.session import checkpointed

RANK_COLUMN = re.compile(r".*_norm\d+$")


def find_rank_column(df: DataFrame, prefix: str = "_") -> str:
    """The first column named like a normalised rank."""
    for name in df.columns:
        if name.startswith(prefix) and RANK_COLUMN.match(name):
            return name
    raise ValueError("no normalised rank column; name one")


def layer_in_view(df: DataFrame, keys: Sequence[str], score: str = "score", **cutting) -> DataFrame:
    """0-based place of each particle in its view, best score first."""
    return ranked(df, keys, score, descending=True, out="layer", **cutting)


def equalised_rank(
    particles: DataFrame,
    views: int,
    half: str | None = None,
    rot: str = "rot",
    tilt: str = "tilt",
    score: str = "score",
    normalise: bool = True,
    compat: bool = True,
    out: str = "rank",
    **cutting,
) -> DataFrame:
    """Rank in [0, 1) that takes views in turn: first each view's best, then the seconds, ...

    Inside a layer particles are ordered by score divided by their view's best (raw in the
    first layer or when that best is not positive), ties by view. With ``half`` the rows
    with value 1 and the others are ranked apart.

    A particle with a missing angle has no view, so ``view``, ``layer``, ``norm_score`` and the rank are NULL, and
    the ranks of the others are as if it were not there. Only row number, half, view and score are shuffled
    and kept on the way; the ranks are joined back by the unique row number ``_row`` (or ``tie``).

    No global sort: a layer holds at most one particle per view, and the number of
    particles in earlier layers is the sum over views of min(view size, layer), which
    follows from the view sizes alone.
    """
    split = F.when(F.col(half) == 1, F.lit(1)).otherwise(F.lit(2)) if half else F.lit(1)
    # cut points come from the input, before the costlier steps
    cuts = cutting.pop("cuts", None)
    cuts = splitters(particles, score, cutting.pop("splits", None)) if cuts is None else cuts
    tie = cutting.pop("tie", "_row")
    narrow = particles.select(F.col(tie).alias("_row"), F.col(score).alias("_score"), F.col(rot).alias("_rot"), F.col(tilt).alias("_tilt"), split.alias("_half"))
    placed = nearest_view(narrow, views, "_rot", "_tilt", "view", compat).filter("view is not null")
    layered = checkpointed(layer_in_view(placed.select("_row", "_half", "view", "_score"), ["_half", "view"], "_score", cuts=cuts, **cutting))
    sizes = layered.groupBy("_half", "view").agg(F.count(F.lit(1)).alias("_m"), F.max("_score").alias("_best"))
    sizes = checkpointed(sizes)
    # one row per half and view, so it fits the driver and every executor
    counts: dict[int, list[int]] = {}
    for row in sizes.select("_half", "_m").collect():
        counts.setdefault(row["_half"], []).append(row["_m"])
    turn = F.row_number().over(Window.partitionBy("_half", "layer").orderBy(F.col("norm_score").desc(), F.col("view")))
    places = (
        layered.join(F.broadcast(sizes.drop("_m")), ["_half", "view"])
        .withColumn("norm_score", _norm_score("_score", normalise))
        .withColumn("_turn", turn)
        .withColumn("_full", _full_views(counts))
        .select(F.col("_row").alias(tie), "view", "layer", "norm_score", _place_in_turns(counts).alias(out))
    )
    return particles.join(places, tie, "left")


def _full_views(counts: dict[int, list[int]]):
    """How many views of the row's half are used up before its layer."""
    out = None
    for half, sizes in counts.items():
        used = count_at_most(F.col("layer").cast("double"), sorted(sizes))
        out = F.when(F.col("_half") == half, used) if out is None else out.when(F.col("_half") == half, used)
    return out if out is not None else F.lit(0)


def _place_in_turns(counts: dict[int, list[int]]):
    """Rank from the layer and the place in it.

    Before layer L come all particles of used-up views and L of every other view.
    """
    out = None
    for half, sizes in counts.items():
        sums = [0]
        for n in sorted(sizes):
            sums.append(sums[-1] + n)
        used = F.split(F.lit(",".join(map(str, sums))), ",").cast("array<bigint>")
        before = F.element_at(used, F.col("_full") + 1) + F.col("layer") * (len(sizes) - F.col("_full"))
        rank = (before + F.col("_turn") - 1) / F.lit(sums[-1])
        out = F.when(F.col("_half") == half, rank) if out is None else out.when(F.col("_half") == half, rank)
    return out if out is not None else F.lit(None).cast("double")


def _norm_score(score: str, normalise: bool):
    if not normalise:
        return F.col(score)
    return F.when((F.col("_best") > 0) & (F.col("layer") > 0), F.col(score) / F.col("_best")).otherwise(F.col(score))


def select_ranked(
    df: DataFrame,
    n: int,
    by: str | None = None,
    worst: bool = False,
    exact: bool = False,
    tie: str = "_row",
    **narrowing,
) -> DataFrame:
    """The ``n`` rows with the lowest (or highest) rank value; ``_row`` keeps the file order.

    Rows without a rank come last. ``exact`` fails when fewer than ``n`` rows exist. See ``first_rows``.
    """
    by = by or find_rank_column(df)
    if exact and df.count() < n:
        raise ValueError(f"fewer than {n} rows to select from")
    return first_rows(df, n, by, tie, descending=worst, **narrowing)


def checkpoint_counts(
    df: DataFrame,
    counts: Sequence[int],
    by: str,
    jobs: Sequence[str],
    tie: str = "_row",
    **cutting,
) -> DataFrame:
    """For every count C, how many of the best C rows fall to each job (class, half, ...).

    One ranking and one grouping for all counts: a row is tallied at the first count that
    includes it, and the tallies are then summed up the (few) counts.
    """
    marks = sorted(set(counts))
    places = ranked(df, [], by, tie=tie, out="_place", **cutting)
    first = None
    for mark in marks:
        test = F.col("_place") < mark
        first = F.when(test, F.lit(mark)) if first is None else first.when(test, F.lit(mark))
    tally = places.withColumn("_mark", first.cast("bigint")).filter("_mark is not null").groupBy(*jobs, "_mark").agg(
        F.count(F.lit(1)).alias("_m")
    )
    steps = F.array(*[F.lit(m).cast("bigint") for m in marks])
    return (
        tally.withColumn("checkpoint", F.explode(F.filter(steps, lambda s: s >= F.col("_mark"))))
        .groupBy("checkpoint", *jobs)
        .agg(F.sum("_m").alias("n"))
    )


def number_in_runs(df: DataFrame, value: str, order: str = "_row", out: str = "number", chunk: int | None = None) -> DataFrame:
    """1-based number inside each run of consecutive rows with the same ``value``."""
    from motes.operators.ordered import CHUNK_ROWS, running

    size = chunk or CHUNK_ROWS
    marked = running(df, [], order, {"_prev": ("lag", F.col(value)), "_at": ("sum", F.lit(1).cast("bigint"))}, chunk=size)
    starts = F.when((F.col("_at") == 1) | ~F.col("_prev").eqNullSafe(F.col(value)), F.col("_at"))
    # "_at" of a lag row counts the row itself, so the run start is the largest start so far
    runs = running(marked.withColumn("_start", starts), [], order, {"_from": ("max", F.col("_start"))}, chunk=size)
    return runs.withColumn(out, F.col("_at") - F.col("_from") + 1).drop("_prev", "_at", "_start", "_from")


def assign_ids(new: DataFrame, existing_names, prefix: str = "P", start: int = 1, order: str = "_row") -> DataFrame:
    """Continue the numbering of ``existing_names`` (a one-column table of names)."""
    name = existing_names.columns[0]
    number = F.regexp_extract(F.col(name), f"^{re.escape(prefix)}(\\d+)$", 1)
    top = existing_names.agg(F.coalesce(F.max(number.try_cast("bigint")), F.lit(0)).alias("m"))
    first = F.greatest(top.scalar() + 1, F.lit(start))
    numbered = position(new, [], order, "_pos").withColumn("particle_id", (F.col("_pos") + first).cast("bigint"))
    text = F.col("particle_id").cast("string")
    digits = F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))
    return numbered.withColumn("particle_name", F.concat(F.lit(prefix), digits)).drop("_pos")


def last_rows(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows per group by a unique integer ``order``.

    Ranked in pieces, so that neither a crowded group nor a long tail meets in one task.
    """
    return ranked(df, keys, order, tie=order, descending=True, out="_rn").filter(F.col("_rn") < n).drop("_rn")
