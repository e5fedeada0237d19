"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.llm.common import boxed, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for was on with as by at are be this from or an it "
    "der die das und ist den von zu mit auf für ein eine dem nicht des im "
    "le la les de et un une est que en du pour qui dans pas "
    "el los y se del las por con para es al"
).split()

_EITHER_CASE = sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= measure <= high``; a null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# The first two are the base rules, the rest are the method's own.
BASE_RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("repeats_itself", "repeat_percent", high=20),
)
RULES = (
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("word_length_low", "mean_word_length", low=2),
    Rule("word_length_high", "mean_word_length", high=16),
    Rule("capitals", "capital_ratio", high=0.4),
    Rule("letters", "letter_ratio", low=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_ratio", high=0.9),
    Rule("cut_lines", "ellipsis_ratio", high=0.5),
)


def _with_next(left: str, right: str, far: int) -> Column:
    """At each place the hash of ``left`` there and of ``right`` ``far`` places on."""
    return F.zip_with(left, F.slice(right, far + 1, F.greatest(F.size(right), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _repeat_starts(w: Column) -> Column:
    """Starts of the windows that occur twice or more; ``w``: (hash, start), sorted."""
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), w)
    after = F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))
    both = F.zip_with(w, before, lambda x, y: F.when(x["h"] == y["h"], x["p"]))
    return F.sort_array(
        F.array_distinct(
            F.array_compact(F.concat(both, F.zip_with(w, after, lambda x, y: F.when(x["h"] == y["h"], x["p"]))))
        )
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the document) and its measures, in narrow projections only."""
    one = boxed(docs).select("row", F.coalesce(F.col(f"row.{text}"), F.lit("")).alias("t"))
    one = one.select(
        "row",
        "t",
        words(F.col("t")).alias("ws"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]", "")) > 0).alias("ls"),
    )
    # a cheap look at hashes first: most texts repeat no window, and need no sorting
    one = one.select("*", F.when(F.size("ws") > WINDOW, F.transform("ws", lambda x: F.xxhash64(x))).alias("h1"))
    one = one.select("*", _with_next("h1", "h1", 1).alias("h2"))
    one = one.select("*", _with_next("h2", "h2", 2).alias("h4"))
    one = one.select("*", F.slice(_with_next("h4", "h1", 4), 1, F.size("ws") - (WINDOW - 1)).alias("hs"))
    one = one.select(
        "*",
        F.when(
            F.size(F.array_distinct("hs")) < F.size("hs"),
            F.sort_array(F.zip_with("hs", F.sequence(F.lit(1), F.size("hs")), lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).alias("win"),
    )
    one = one.select("row", "t", "ws", "ls", F.when(F.col("win").isNotNull(), _repeat_starts(F.col("win"))).alias("at"))
    gaps = F.zip_with(
        "at",
        F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)),
    )
    counted = one.select(
        "row",
        "t",
        "ws",
        "ls",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    lines = F.when(F.size("ls") > 0, F.size("ls"))

    def share(of: str, test, total: Column) -> Column:
        return F.size(F.filter(of, test)) / total

    return counted.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (100 * F.col("n_repeat_words") / n).alias("repeat_percent"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("word_chars") / n).alias("mean_word_length"),
        (F.length(F.regexp_replace("t", r"[^A-ZÀ-ÖØ-Þ]+", "")) / chars).alias("capital_ratio"),
        (1 - F.length(F.regexp_replace("t", r"[A-Za-z\x80-\x{10FFFF}\x20\x09-\x0D]+", "")) / chars).alias("letter_ratio"),
        # in a short text no function word may occur by chance
        F.when(F.col("n_words") >= 50, share("ws", lambda x: x.isin(_EITHER_CASE), n)).alias("stop_ratio"),
        F.when(lines >= 10, F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        F.when(lines >= 10, share("ls", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"), lines)).alias("bullet_ratio"),
        F.when(lines >= 10, share("ls", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"), lines)).alias("ellipsis_ratio"),
    )


def broken(rules: Sequence[Rule]) -> Column:
    """The threshold table as one expression: the names of the rules that a row breaks."""
    tests = []
    for r in rules:
        m = F.col(r.measure)
        out = F.lit(False)
        if r.low is not None:
            out = out | (m < r.low)
        if r.high is not None:
            out = out | (m > r.high)
        tests.append(F.when(F.coalesce(out, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measures, broken rules and verdict of each document, as ``row`` and further columns.

    Null and blank texts have no words, all counts are 0 and ``too_short`` rejects them.
    Repeated rows are judged each alone and alike; an empty table gives an empty one; the
    document stays whole inside ``row``, so its column names can't clash with the new ones.
    One narrow stage: no shuffle, no state, any lost task is simply run again.
    """
    return (
        measured(docs, text)
        .withColumn("base_broken", broken(BASE_RULES))
        .withColumn("base_failed", F.size("base_broken") > 0)
        .withColumn("rules_broken", broken(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rules_broken") == 0))
    )


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    The row number is there to keep the optimizer from moving the filter below the measures,
    where it would compute each of them again for every rule that asks for it.
    """
    judged = quality_rules(docs, text, rules).select("row", "kept", F.monotonically_increasing_id().alias("at"))
    return judged.filter(F.col("kept") & (F.col("at") >= 0)).select("row.*")
