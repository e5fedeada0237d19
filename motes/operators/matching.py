"""Joins between particle tables and the tables around them.

One-to-one matches pair the n-th row of a key on one side with the n-th on the other.
After pairing, (key, n) is unique, so a key that holds a third of all rows spreads over
the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.functions.keys import simple_name
from motes.operators.checks import require
from motes.operators.ordered import position
from motes.operators.summaries import first_of_key
from motes.session import checkpointed


def with_optics(particles: DataFrame, optics: DataFrame, key: str, keep_key: bool = False) -> DataFrame:
    """Add optics fields; particles of unknown groups are dropped."""
    out = particles.join(optics, key, "inner")
    return out if keep_key else out.drop(key)


def with_checked_optics(particles: DataFrame, optics: DataFrame, key: str) -> DataFrame:
    """Add optics fields; a repeated group or a particle without one is an error."""
    rest = [c for c in optics.columns if c != key]
    groups = optics.groupBy(key).agg(F.any_value(F.struct(F.lit(True), *rest)).alias("_o"), F.count(F.lit(1)).alias("_copies"))
    once = require(groups, F.col("_copies") == 1, "an optics group occurs more than once").drop("_copies")
    joined = require(particles.join(once, key, "left"), F.col("_o").isNotNull(), "a particle has no optics group")
    return joined.select(*particles.columns, *[F.col("_o")[c].alias(c) for c in rest])


def recover_optics(optics: DataFrame, particles: DataFrame, key: str, fields: Sequence[str], order: str = "_row") -> DataFrame:
    """Fill missing optics fields with the first value that a group's particles carry."""
    have = [c for c in fields if c in particles.columns]
    found = particles.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_p_{c}") for c in have]
    )
    joined = optics.join(found, key, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_p_{c}")) if c in optics.columns else F.col(f"_p_{c}") for c in have}
    return joined.withColumns(filled).drop(*[f"_p_{c}" for c in have])


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose image key the other table lacks."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def common_with(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose image key the other table has too."""
    return df.join(other.select(*keys), list(keys), "left_semi")


# --- back-mapping ----------------------------------------------------------


def _lookup(mapping: DataFrame, key: str, source: str) -> DataFrame:
    return mapping.groupBy(key).agg(
        F.min(source).alias("_source"), F.max(source).alias("_other"), F.count(F.lit(1)).alias("_copies")
    )


def back_map(
    processed: DataFrame, mapping: DataFrame, key: str, source: str, strict: bool = True, audit: str | None = None
) -> DataFrame:
    """Replace the image key by the one it came from.

    A key mapped to two sources is an error; with ``strict`` so is an unmapped key, which
    otherwise stays as it is. ``audit`` keeps the old key in a column of that name.
    """
    lookup = _lookup(mapping, key, source)
    single = require(lookup, F.col("_source").eqNullSafe(F.col("_other")), F.concat(F.lit("more than one source for "), F.col(key).cast("string")))
    joined = processed.join(single.select(key, "_source", "_copies"), key, "left")
    if strict:
        joined = require(joined, F.col("_copies").isNotNull(), F.concat(F.lit("no source; pass strict=False to keep "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    joined = joined.drop("_copies")
    if audit:
        joined = joined.withColumn(audit, F.col(key))
    return joined.withColumn(key, F.coalesce("_source", key)).drop("_source")


def back_map_report(processed: DataFrame, mapping: DataFrame, key: str, source: str) -> DataFrame:
    """One row: processed, mapping, mapped and missing rows; repeated and conflicting keys."""
    lookup = _lookup(mapping, key, source)
    rows = processed.join(lookup.select(key, "_copies"), key, "left").agg(
        F.count(F.lit(1)).alias("n_processed"),
        F.count("_copies").alias("n_mapped"),
        F.count_if(F.col("_copies").isNull()).alias("n_missing"),
    )
    keys = lookup.agg(
        F.sum("_copies").alias("n_mapping_rows"),
        F.count_if((F.col("_copies") > 1) & (F.col("_source") == F.col("_other"))).alias("n_repeated"),
        F.count_if(F.col("_source") != F.col("_other")).alias("n_conflicting"),
    )
    both = rows.unionByName(keys, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- updates ---------------------------------------------------------------


def update_columns(df: DataFrame, template: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str = "_row") -> DataFrame:
    """Take columns from the template's first row of the same key; others stay as they are."""
    firsts = first_of_key(template.select(order, *keys, *columns), keys, order).select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_t_{c}") for c in columns]
    )
    joined = df.join(firsts, list(keys), "left")
    fresh = {c: F.when(F.col("_hit"), F.col(f"_t_{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c in columns}
    return joined.withColumns(fresh).drop("_hit", *[f"_t_{c}" for c in columns])


def override_rows(df: DataFrame, updates: DataFrame, keys: Sequence[str], order: str = "_row", **cutting) -> DataFrame:
    """Replace whole rows by updates of the same key, each update used once, in file order."""
    rest = [c for c in df.columns if c not in keys and c != order]
    a = position(df, keys, order, "_n", **cutting)
    b = position(updates, keys, order, "_n", **cutting).select(*keys, "_n", F.struct(*rest).alias("_new"))
    joined = a.join(b, [*keys, "_n"], "left")
    return joined.select(
        order,
        *keys,
        *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in rest],
        F.col("_new").isNotNull().alias("updated"),
    )


def pair_rows(
    left: DataFrame, right: DataFrame, on: Mapping[str, Column], take: Mapping[str, str], order: str = "_row", how: str = "inner", **cutting
) -> DataFrame:
    """One-to-one match on expressions, in file order, taking columns of the right side.

    ``on`` maps a name to an expression that both tables can compute; ``take`` maps an
    output column to a column of the right table.
    """
    names = [f"_on_{n}" for n in on]
    tests = {f"_on_{n}": e for n, e in on.items()}
    a = position(left.withColumns(tests), names, order, "_n", **cutting)
    b = position(right.withColumns(tests), names, order, "_n", **cutting).select(
        *names, "_n", *[F.col(c).alias(out) for out, c in take.items()]
    )
    return a.join(b, [*names, "_n"], how).drop("_n", *names)


def match_positions(left: DataFrame, right: DataFrame, mic="mic", x="x", y="y", image="image", **cutting) -> DataFrame:
    """Rewrite image keys to those of the right table at the same micrograph position."""
    out = pair_rows(left, right, {"m": F.col(mic), "x": F.col(x), "y": F.col(y)}, {"_image": image}, **cutting)
    return out.withColumn(image, F.col("_image")).drop("_image")


def match_rounded(template: DataFrame, images: DataFrame, parameters: Sequence[str], image="image", out="matched_image", **cutting) -> DataFrame:
    """Template rows with the image whose parameters agree to the nearest whole number.

    Each image is used once; template rows without one are dropped.
    """
    on = {c: F.round(F.col(c)).cast("bigint") for c in parameters}
    return pair_rows(template, images, on, {out: image}, **cutting)


def update_from_array(df: DataFrame, array: DataFrame, keys: Sequence[str] | None, columns: Sequence[str], order: str = "_row") -> DataFrame:
    """Update from an external array by key (first duplicate wins) or, without keys, by row.

    No match at all is an error.
    """
    on = list(keys or [order])
    hits = df.join(array.select(*on), on, "left_semi").limit(1).count()
    if not hits:
        raise ValueError("no row of the array matches")
    if keys:
        return update_columns(df, array, keys, columns, order)
    fresh = array.select(order, *[F.col(c).alias(f"_t_{c}") for c in columns])
    joined = df.join(fresh, order, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_t_{c}"), F.col(c)) for c in columns}).drop(*[f"_t_{c}" for c in columns])


def best_refinement(reference: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], score: str, parameters: Sequence[str]) -> DataFrame:
    """Parameters of the best-scored refinement per image; ties go to the later table.

    Every reference row stays and competes with its own score; a refinement's repeated
    image counts once, by its first row.
    """
    stacked = None
    for i, df in enumerate(others):
        first = first_of_key(df.select("_row", *keys, score, *parameters), keys)
        part = first.select(*keys, score, *parameters, F.lit(i + 1).alias("source"))
        stacked = part if stacked is None else stacked.unionByName(part)
    best = stacked.groupBy(*keys).agg(
        F.max_by(F.struct(score, *parameters, "source"), F.struct(score, "source")).alias("_best")
    )
    wins = F.col("_best").isNotNull() & (F.col("_best")[score] >= F.col(score))
    taken = {c: F.when(wins, F.col("_best")[c]).otherwise(F.col(c)) for c in parameters}
    taken["source"] = F.when(wins, F.col("_best")["source"]).otherwise(F.lit(0))
    return reference.join(best, list(keys), "left").withColumns(taken).drop("_best")


# --- names and paths -------------------------------------------------------


def assign_micrographs(particles: DataFrame, micrographs: DataFrame, name: str = "mic", mic_row: str = "_row", batch: int = 200_000) -> DataFrame:
    """Add ``mic_row``: the first micrograph whose simplified name is part of the particle's.

    Works on distinct names. An automaton over micrograph names runs once through each particle
    name and sees every name that ends at each place, so no row is made per piece of a name and no pair
    of names is compared. A task holds an automaton of about ``batch`` micrograph names and as many particle
    names; where there are more, each share of the one meets each share of the other.
    """
    mics = checkpointed(micrographs.groupBy(simple_name(F.col(name)).alias("_piece")).agg(F.min(mic_row).alias("mic_row")).filter("_piece IS NOT NULL"))
    names = checkpointed(particles.select(simple_name(F.col(name)).alias("_simple")).filter("_simple IS NOT NULL").distinct())
    left, right = names.count() // batch + 1, mics.count() // batch + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    texts = names.withColumn("_share", F.pmod(F.hash("_simple"), F.lit(left))).withColumn("_part", every(right))
    patterns = mics.withColumn("_part", F.pmod(F.hash("_piece"), F.lit(right))).withColumn("_share", every(left))
    kind = mics.schema["mic_row"].dataType.simpleString()

    def search(texts: pa.Table, patterns: pa.Table) -> pa.Table:
        import ahocorasick

        found = ahocorasick.Automaton()
        pieces = dict(zip(patterns.column("_piece").to_pylist(), patterns.column("mic_row").to_pylist(), strict=True))
        anywhere = pieces.pop("", None)  # an empty name is part of every name
        for piece, row in pieces.items():
            found.add_word(piece, row)
        found.make_automaton()
        simple, rows = texts.column("_simple").to_pylist(), []
        for text in simple:
            hits = [row for _, row in found.iter(text)] if pieces else []
            rows.append(min(hits if anywhere is None else [*hits, anywhere], default=None))
        return pa.table({"_simple": pa.array(simple, pa.string()), "mic_row": pa.array(rows, patterns.schema.field("mic_row").type)})

    on = ["_share", "_part"]
    hits = texts.groupBy(*on).cogroup(patterns.groupBy(*on)).applyInArrow(search, f"_simple string, mic_row {kind}")
    found = hits.filter("mic_row IS NOT NULL").groupBy("_simple").agg(F.min("mic_row").alias("mic_row"))
    return particles.withColumn("_simple", simple_name(F.col(name))).join(found, "_simple", "left").drop("_simple")


def transfer_fields(particles: DataFrame, micrographs: DataFrame, fields: Sequence[str], bin_factor: float = 1.0, coordinates=("x", "y")) -> DataFrame:
    """Copy micrograph fields to assigned particles and bring coordinates to its pixel size."""
    side = micrographs.select(F.col("_row").alias("mic_row"), *fields)
    return particles.join(side, "mic_row", "left").withColumns({c: F.col(c) / F.lit(bin_factor) for c in coordinates})


def import_by_name(particles: DataFrame, micrographs: DataFrame, columns: Sequence[str], name: str = "mic", order: str = "_row") -> DataFrame:
    """Import micrograph columns (such as defocus) by simplified name, first match."""
    firsts = first_of_key(
        micrographs.select(order, simple_name(F.col(name)).alias("_simple"), *columns), ["_simple"], order
    ).select("_simple", *[F.col(c) for c in columns])
    return particles.drop(*columns).withColumn("_simple", simple_name(F.col(name))).join(firsts, "_simple", "left").drop("_simple")


def resolve_paths(stacks: DataFrame, files: DataFrame, root: str | None, beside: str | None, mode: str = "auto", path: str = "stack") -> DataFrame:
    """Where each stack lies: below ``root``, as written, or beside the table.

    Strict modes (``root``, ``as_is``, ``beside``) name one place without looking; ``auto``
    takes the first place that exists, or the first one if none does.
    """
    from motes.functions.keys import normal_path

    at = F.col(path)
    as_is = normal_path(at)
    below = {"root": root, "beside": beside}
    joined = {k: normal_path(F.concat(F.lit(v.rstrip("/") + "/"), at)) if v else None for k, v in below.items()}
    absolute = at.startswith("/")
    if mode in ("root", "as_is", "beside"):
        place = joined.get(mode) if mode != "as_is" and joined.get(mode) is not None else as_is
        return stacks.withColumn("resolved", F.when(absolute, at).otherwise(place))
    if mode != "auto":
        raise ValueError(f"unknown mode {mode}")
    order = [c for c in (joined["root"], as_is, joined["beside"]) if c is not None]
    names = stacks.select(path).distinct()
    tried = F.when(absolute, F.array(at)).otherwise(F.array(*order))
    cands = names.select(path, F.posexplode(tried).alias("_prio", "_cand"))
    there = files.select(F.col("path").alias("_cand"), F.lit(True).alias("_there")).distinct()
    best = (
        cands.join(there, "_cand", "left")
        .groupBy(path)
        .agg(F.min_by("_cand", F.struct(F.col("_there").isNull(), F.col("_prio"))).alias("resolved"))
    )
    return stacks.join(best, path, "left")


def gather_slices(particles: DataFrame, slices: DataFrame, out_stack: str, strict: bool = True) -> DataFrame:
    """New stack: the listed slices in table order with new keys and where they came from.

    ``particles`` has ``image_no`` (1-based) and ``stack``; ``slices`` has ``slice``
    (0-based), ``stack``, ``ny``, ``nx``, ``px``. Missing slices and unequal image sizes
    are errors.
    """
    from motes.functions.keys import image_key

    wanted = position(particles, [], "_row", "_pos").withColumn("slice", F.col("image_no") - 1)
    joined = wanted.join(slices, ["stack", "slice"], "left")
    if strict:
        joined = require(joined, F.col("px").isNotNull(), F.concat(F.lit("a slice is missing: "), F.coalesce(image_key(F.col("image_no"), F.col("stack")), F.lit("NULL"))))
        # sizes alone are compared first, without pixels
        sizes = wanted.select("stack", "slice").join(slices.select("stack", "slice", "ny", "nx"), ["stack", "slice"])
        joined = require(joined, F.col("px").isNull() | (F.struct("ny", "nx") == sizes.agg(F.min(F.struct("ny", "nx")).alias("s")).scalar()), "slices differ in size")
    return joined.select(
        "_row",
        image_key(F.col("_pos") + 1, F.lit(out_stack)).alias("image"),
        image_key(F.col("image_no"), F.col("stack")).alias("source_image"),
        "px",
    )


# --- ranges and registries -------------------------------------------------


def expand_ranges(entries: DataFrame, start: str, end: str, keys: Sequence[str], order: str, fields: Sequence[str], out: str = "index") -> DataFrame:
    """One row per covered index; where ranges overlap the later entry wins."""
    rows = entries.filter(F.col(start) <= F.col(end)).withColumn(out, F.explode(F.sequence(start, end)))
    last = rows.groupBy(*keys, out).agg(F.max_by(F.struct(*fields), order).alias("_last"))
    return last.select(*keys, out, *[F.col("_last")[c].alias(c) for c in fields])


def _bins(start: Column, end: Column) -> Column:
    """A range as bins of power-of-two width: ``(level, bin)`` stands for bin * 2^level and what follows, 2^level numbers.

    At each level, an end that does not fill a bin of the next level is a bin of its own; so a
    range of length n is at most about 2 log2(n) bins, and only levels that fit in the range are looked at.
    """
    a, b = start.cast("bigint"), end.cast("bigint") + 1
    shift = lambda value, level: F.call_function("shiftright", value, level)
    odd = lambda value: value.bitwiseAND(F.lit(1).cast("bigint")) == 1

    def ends(level: Column) -> Column:
        first, stop = -shift(-a, level), shift(b, level)
        at = lambda bin: F.struct(level.alias("level"), bin.alias("bin"))
        return F.array(F.when((first < stop) & odd(first), at(first)), F.when((first < stop) & odd(stop), at(stop - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(b - a)) - 1), ends)))


def last_covering(points: DataFrame, point: str, entries: DataFrame, start: str, end: str, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Every row of ``points`` with the fields of the last entry of its keys whose range holds it, NULL where none does.

    Ranges become bins of power-of-two width, of which each keeps its last entry; a point is in one bin of each width
    that occurs. So this is an equi-join on a unique key, whose rows grow with the points and the logarithm of a
    range's length, however many ranges hold a point.
    """
    on = list(keys)
    # a small file is one task otherwise, and its bins are many
    spread = entries.filter(F.col(start) <= F.col(end)).repartition(entries.sparkSession.sparkContext.defaultParallelism)
    binned = spread.select(*on, order, *fields, F.explode(_bins(F.col(start), F.col(end))).alias("_b"))
    binned = binned.select(*on, F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin"), F.struct(*fields).alias("_fields"), F.col(order).alias("_order"))
    binned = binned.groupBy(*on, "_level", "_bin").agg(F.max_by("_fields", "_order").alias("_fields"), F.max("_order").alias("_order"))
    levels = binned.agg(F.array_sort(F.collect_set("_level")).alias("l")).scalar()  # at most 63
    asked = points.select(*on, F.col(point).cast("bigint").alias("_point")).distinct().withColumn("_level", F.explode(levels))
    asked = asked.withColumn("_bin", F.call_function("shiftright", F.col("_point"), F.col("_level")))
    best = asked.join(binned, [*on, "_level", "_bin"]).groupBy(*on, "_point").agg(F.max_by("_fields", "_order").alias("_last"))
    joined = points.withColumn("_point", F.col(point).cast("bigint")).join(best, [*on, "_point"], "left")
    return joined.select(*points.columns, *[F.col("_last")[c].alias(c) for c in fields])


def reconcile(registered: DataFrame, on_disk: DataFrame, crops: Mapping[str, DataFrame], keys=("tomo", "particle")) -> DataFrame:
    """Differences between the registry, the particle files and the cropped images."""
    on = list(keys)

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on).distinct().withColumn(name, F.lit(True))

    seen = flag(registered, "_reg").join(flag(on_disk, "_disk"), on, "full_outer")
    for kind, df in crops.items():
        seen = seen.join(flag(df, f"_{kind}"), on, "full_outer")
    issues = [
        F.when(F.col("_reg").isNotNull() & F.col("_disk").isNull(), F.lit("registered_but_no_star")),
        F.when(F.col("_reg").isNull() & F.col("_disk").isNotNull(), F.lit("star_not_registered")),
        *[F.when(F.col(f"_{k}").isNotNull() & F.col("_disk").isNull(), F.lit(f"orphan_{k}_crop")) for k in crops],
    ]
    return seen.select(*on, F.explode(F.array_compact(F.array(*issues))).alias("issue"))
