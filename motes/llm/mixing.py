"""Mixing sources to target weights: repetition rates per source, copies per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.llm.common import boxed, n_words
from motes.session import checkpointed

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# One row per source; a table of sources larger than this is joined by a shuffle instead.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """Target size and repetition rate of each source (``source``, ``source_size``).

    Sources by code point, null last, take the weights in turn. A source gets
    ``min(most * size, level * weight)``, where one level makes the targets add up to all
    sizes: the fixed point of capping and resharing by weight. In the order of
    ``most * size / weight`` the capped sources come first, so the level follows from
    running sums over one row per source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.partitionBy(F.lit(0)).orderBy("full", F.col("source").asc_nulls_last())
    done = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    return (
        sizes.withColumn("weight", turn)
        .withColumn("full", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
        # the level if this source were the first that isn't capped
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(done), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("open", F.when(F.col("full") >= F.col("level"), F.col("level")))
        # the first source that isn't capped has the level of all
        .withColumn("level", F.first("open", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)))
        .select("source", "source_size", "weight", "target", "rate")
    )


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST_REPEATS,
    seed: int = 0,
) -> DataFrame:
    """``row`` with its ``size``, its source's ``source_size``, ``target`` and ``rate``, and ``copies``.

    A document is taken ``floor(rate)`` times, and once more if its draw is below the
    fraction that is left. The draw depends on the seed and the key alone, so reruns
    agree, and repeated rows with one key fare alike. Null text: size 0. Null source: a
    source of its own, the last. Null key: the draw of an empty key. Empty table: empty.

    Sizes are added up per source before the shuffle, so a source with a third of all
    rows costs one row a task; its documents then meet the small table of sources without
    being moved.
    """
    sized = boxed(docs).select("row", n_words(F.col(f"row.{text}")).alias("size"))
    # one row per source, counted and joined below: the texts are read once for it
    sums = checkpointed(sized.groupBy(F.col(f"row.{source}").alias("source")).agg(F.sum("size").alias("source_size")))
    aims = targets(sums, weights, most).select(F.struct("source").alias("at"), "source_size", "target", "rate")
    few = sums.count() <= BROADCAST_SOURCES
    joined = sized.withColumn("at", F.struct(F.col(f"row.{source}").alias("source"))).join(F.broadcast(aims) if few else aims, "at")
    whole = F.floor("rate")
    extra = draw(F.col(f"row.{key}"), seed) < F.col("rate") - whole
    return joined.select(
        "row",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        "rate",
        (whole + extra.cast("long")).cast("long").alias("copies"),
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    return (
        mixed(docs, **options)
        .filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select("row.*")
    )
