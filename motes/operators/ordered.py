"""Order-dependent building blocks that never put a whole group into one task.

A plain window sends every row of a group to one task, which fails when one group holds
a third of all rows. The functions here cut a group into ordered chunks, work inside each
chunk, and add what the earlier chunks carry over. The carried values form a table with
one row per chunk, so the second window is small. Results equal those of a plain window.

Two ways of cutting are used: by ranges of an integer row number (``position``,
``running``), and by ranges of any sortable value (``ranked``, ``order_statistics``).
"""

from __future__ import annotations

import json
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, FloatType, LongType, NumericType, StringType, StructField, StructType

from motes.operators.sketches import as_number, is_nan, quantile_grid
from motes.session import checkpointed

# Row numbers per chunk: the most rows a task sorts for one group and chunk.
CHUNK_ROWS = 1 << 20
# Rows aimed at between two cut points of a value range, and sampled values per cut point.
ROWS_PER_SPLIT = 2_000_000
SAMPLED_PER_SPLIT = 16
# Of the sketch that bounds an order statistic: its size (rank error about 0.4 %), the quantiles
# asked of it, and how much wider than one of their steps a bound is.
SKETCH = 1024
GRID = 250
SLACK = 0.008
# Values that are sorted in one row at most.
BORDER = 100_000


def group_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Columns that stand for ``keys`` in windows and joins.

    Where a key can be NULL the keys are wrapped in a struct: structs compare equal when
    both hold NULL, and a plain equi-join on them keeps the window's partitioning.
    """
    if all(not df.schema[k].nullable for k in keys):
        return df, list(keys)
    return df.withColumn("_key", F.struct(*keys)), ["_key"]


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join where NULL keys equal each other; keeps the left copy of the keys."""
    a = left.withColumn("_jk", F.struct(*keys))
    b = right.withColumn("_jk", F.struct(*keys)).drop(*keys)
    return a.join(b, "_jk", how).drop("_jk")


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("bigint"))


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "_row",
    out: str = "_pos",
    chunk: int = CHUNK_ROWS,
    sparse: bool = False,
) -> DataFrame:
    """0-based position among the rows with equal ``keys``, by a unique integer ``order``."""
    counted = running(df, keys, order, {out: ("sum", F.lit(1).cast("bigint"))}, chunk=chunk, sparse=sparse)
    return counted.withColumn(out, F.col(out) - 1)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    chunk: int = CHUNK_ROWS,
    sparse: bool = False,
) -> DataFrame:
    """Running ``sum``/``min``/``max`` or the previous row's value (``lag``) per group.

    ``order`` is a unique integer column, such as a row number. ``sparse`` is for numbers
    that spread far wider than there are rows (arbitrary ids): chunks are then many, and
    are chunked again. With ``inclusive=False`` the current row does not count. ``lag``
    gives the value on the row before, NULL on a group's first row.
    """
    df, keys = group_key(df, keys)
    base = _chunked(df, order, chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order)
    framed = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    outer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    totals = {"sum": F.sum, "min": F.min, "max": F.max}

    carry = base.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(F.struct(col.alias("v")), order).alias(f"__{out}")
            if kind == "lag"
            else totals[kind](col).alias(f"__{out}")
            for out, (kind, col) in outputs.items()
        ]
    )
    if sparse:
        names = {f"__c_{out}": (kind, F.col(f"__{out}")) for out, (kind, _) in outputs.items()}
        upper = {k: f"_up_{k}" for k in [*keys, "_chunk"]}
        above = running(carry.withColumnsRenamed(upper), [upper[k] for k in keys], upper["_chunk"], names, inclusive=False, chunk=chunk)
        carry = above.withColumnsRenamed({v: k for k, v in upper.items()}).select(*keys, "_chunk", *names)
    else:
        carry = carry.select(*keys, "_chunk", *_carried(outputs, totals, outer, before))

    local = base.select(
        "*",
        *[
            (F.lag(F.struct(col.alias("v"))).over(inner) if kind == "lag" else totals[kind](col).over(framed)).alias(
                f"__l_{out}"
            )
            for out, (kind, col) in outputs.items()
        ],
    )
    joined = local.join(carry, [*keys, "_chunk"], "left")
    result = {}
    for out, (kind, _) in outputs.items():
        a, b = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        if kind == "lag":
            result[out] = F.coalesce(a, b)["v"]
        elif kind == "sum":
            result[out] = F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            )
        else:
            result[out] = F.least(a, b) if kind == "min" else F.greatest(a, b)
    helpers = [f"__{side}_{out}" for side in "lc" for out in outputs]
    return joined.withColumns(result).drop("_chunk", "_key", *helpers)


def _constant(values: Sequence, kind: DataType) -> Column:
    """One constant array in the type of the column, instead of thousands of literals."""
    texts = [repr(v) if isinstance(v, float) else str(v) for v in values]
    return F.from_json(F.lit(json.dumps(texts)), ArrayType(StringType())).cast(ArrayType(kind))


def count_at_most(value: Column, edges: Sequence, kind: DataType | None = None) -> Column:
    """How many of the ascending ``edges`` are at most ``value``, by binary search.

    ``kind`` is the type in which values compare; double by default.
    """
    kind = kind or DoubleType()
    n = len(edges)
    if not n:
        return F.lit(0)
    table = _constant([float(e) for e in edges] if isinstance(kind, DoubleType) else edges, kind)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= n) & (F.element_at(table, F.least(at + step, F.lit(n))) <= value), at + step
        ).otherwise(at),
    )


def _carried(outputs, totals, outer, before) -> list[Column]:
    """What all earlier chunks of the group hand on, per output."""
    return [
        (F.lag(f"__{out}").over(outer) if kind == "lag" else totals[kind](f"__{out}").over(before)).alias(f"__c_{out}")
        for out, (kind, _) in outputs.items()
    ]


def _is_nan(df: DataFrame, by: str) -> Column:
    floating = isinstance(df.schema[by].dataType, (DoubleType, FloatType))
    return F.coalesce(F.isnan(by), F.lit(False)) if floating else F.lit(False)


def _with_bin(df: DataFrame, by: str, edges: Sequence, out: str) -> DataFrame:
    """Add an ordered bin number: even between two edges, odd where all values are equal, which
    are those on an edge, NULL (-1) and NaN (the last)."""
    value, kind = F.col(by), df.schema[by].dataType
    k = F.col("_k")
    placed = F.when(value.isNull(), F.lit(-1)).when(_is_nan(df, by), F.lit(2 * len(edges) + 1))
    if edges:
        on_edge = (k > 0) & (F.element_at(_constant(edges, kind), F.greatest(k, F.lit(1))) == value)
        placed = placed.when(on_edge, 2 * k - 1)
    placed = placed.otherwise(2 * k)
    return df.withColumn("_k", count_at_most(value, edges, kind)).withColumn(out, placed.cast("bigint")).drop("_k")


def splitters(df: DataFrame, by: str, splits: int | None = None) -> list:
    """Values of ``by``, in its own type, that cut the table into pieces of bounded size.

    As many as the row count asks for, so a small table is one piece; a count, and for
    more than one piece a sample of a few values per cut. They only spread the work: a rank does
    not depend on them.
    """
    rows = df.count()
    splits = splits or rows // ROWS_PER_SPLIT
    if not splits:
        return []
    values = df.select(by).filter(F.col(by).isNotNull() & ~_is_nan(df, by))
    found = sorted(r[0] for r in values.sample(min(1.0, SAMPLED_PER_SPLIT * splits / rows), seed=1).collect())
    return sorted({found[len(found) * (i + 1) // (splits + 1)] for i in range(splits)}) if found else []


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: str = "_row",
    descending: bool = False,
    out: str = "_rank",
    cuts: Sequence | None = None,
    splits: int | None = None,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """0-based rank per group by ``by``, ties by the unique integer ``tie`` ascending.

    Equals ``row_number() - 1``. NULLs come first ascending and last descending. The table is
    cut at values of ``by``, compared in its own type; a value that fills a whole piece is
    cut further by ``tie``. ``cuts`` gives the cutting values when they are known beforehand.
    """
    order = F.col(by).desc() if descending else F.col(by).asc()
    if cuts is None:
        cuts = splitters(df, by, splits)
    df, keys = group_key(df, keys)
    base = _with_bin(df, by, cuts, "_bin")
    equal = F.col("_bin") % 2 != 0
    base = base.withColumns({"_sub": F.when(equal, F.floor(F.col(tie) / F.lit(chunk))).otherwise(F.lit(0)).cast("bigint"), "_bin": -F.col("_bin") if descending else F.col("_bin")})
    cells = [*keys, "_bin", "_sub"]
    inner = Window.partitionBy(*cells).orderBy(order, F.col(tie))
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_bin", "_sub")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        base.groupBy(*cells)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    local = base.withColumn(out, F.row_number().over(inner).cast("bigint") - 1)
    return (
        local.join(offsets, cells, "left")
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_bin", "_sub", "_off", "_key")
    )


def value_counts(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    cuts: Sequence | None = None,
    splits: int | None = None,
) -> DataFrame:
    """Distinct values per group with ``_n`` copies, ``_before`` smaller rows and the group's
    size ``_total``.

    Equal values are merged before the shuffle, so a value that holds a third of all
    rows costs one row.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    if cuts is None:
        cuts = splitters(df, by, splits)
    counts, keys = group_key(counts, keys)
    base = _with_bin(counts, by, cuts, "_bin")
    cells = [*keys, "_bin"]
    inner = Window.partitionBy(*cells).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    outer = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*cells)
        .agg(F.sum("_n").alias("_m"))
        .select(*cells, F.coalesce(F.sum("_m").over(outer), F.lit(0)).alias("_off"), F.sum("_m").over(group).alias("_total"))
    )
    local = base.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    return (
        local.join(offsets, cells, "left")
        .withColumn("_before", F.col("_before") + F.col("_off"))
        .drop("_bin", "_off", "_key")
    )


def _interval(index: Column, grid: Column, size: Column) -> tuple[Column, Column]:
    """Bounds between which the value at a sorted index lies if the sketch is right; NULL is open."""
    share = F.try_divide(index, size)
    low, high = F.floor((share - SLACK) * GRID).cast("int"), (F.ceil((share + SLACK) * GRID)).cast("int")
    return F.when(low >= 0, F.get(grid, low)), F.when(high <= GRID, F.get(grid, high))


def _whole_table(df: DataFrame, by: str, picks: Mapping[str, Column], border: int = BORDER) -> DataFrame | None:
    """The order statistics of a whole numeric table as one row; None where a narrow interval stays crowded.

    The bounds are numbers on the driver. All intervals are counted in one pass, and their values, at most ``border``
    each, are sorted in one row.
    """
    names, kind = list(picks), df.schema[by].dataType
    number, plain = as_number(F.col(by), kind)
    values = df.filter(F.col(by).isNotNull()).select(F.col(by).alias("_by"), number.alias("_number"))
    first = values.agg(F.count(F.lit(1)).alias("_n"), F.count_if(~is_nan(F.col("_number"), plain)).alias("real"), quantile_grid(F.col("_number"), plain, GRID, SKETCH).alias("grid")).first()
    one = df.sparkSession.createDataFrame([(first["_n"] or None,)], "_n bigint")
    at = list(one.select(*[picks[name].cast("bigint").alias(name) for name in names]).first())
    if not first["_n"] or first["grid"] is None or any(i is None or not 0 <= i < first["real"] for i in at):
        return None
    low, high, before, inside = [None] * len(at), [None] * len(at), [0] * len(at), [first["real"]] * len(at)
    grids = [first["grid"]] * len(at)

    def within(p: int) -> Column:
        test = ~is_nan(F.col("_number"), plain)
        test = test if low[p] is None else test & (F.col("_number") >= F.lit(low[p]))
        return test if high[p] is None else test & (F.col("_number") <= F.lit(high[p]))

    crowded = list(range(len(at)))
    while crowded:
        tried = {}
        for p in crowded:
            share = (at[p] - before[p]) / inside[p]
            tried[p] = grids[p][max(0, int((share - SLACK) * GRID))], grids[p][min(GRID, int((share + SLACK) * GRID) + 1)]
        counts = []
        for p, (a, b) in tried.items():
            counts += [F.count_if(within(p) & (F.col("_number") < F.lit(a))), F.count_if(within(p) & (F.col("_number") >= F.lit(a)) & (F.col("_number") <= F.lit(b)))]
        got = values.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
        still = []
        for j, p in enumerate(crowded):
            smaller, between = got[2 * j], got[2 * j + 1]
            if not before[p] + smaller <= at[p] < before[p] + smaller + between:
                return None
            shrunk = between <= inside[p] // 2
            low[p], high[p], before[p], inside[p] = *tried[p], before[p] + smaller, between
            if between > border and low[p] != high[p]:
                if not shrunk:
                    return None
                still.append(p)
        crowded = still
        if crowded:
            again = values.agg(*[quantile_grid(F.when(within(p), F.col("_number")), plain, GRID, SKETCH).alias(f"g{p}") for p in crowded]).first()
            for p in crowded:
                grids[p] = again[f"g{p}"]
    # a value that fills its interval needs no sorting
    open_ = [p for p in range(len(at)) if low[p] != high[p]]
    lists = values.filter(reduce(operator.or_, map(within, open_))).agg(*[F.sort_array(F.collect_list(F.when(within(p), F.col("_by"))))[at[p] - before[p]].alias(f"v{p}") for p in open_]).first() if open_ else None
    row = [lists[f"v{p}"] if p in open_ else low[p] for p in range(len(at))]
    schema = StructType([StructField("n", LongType()), *[StructField(f"p{p}", DoubleType() if plain == "double" else LongType()) for p in range(len(at))]])
    found = df.sparkSession.createDataFrame([(first["_n"], *[float(v) if plain == "double" else v for v in row])], schema)
    return found.select("n", *[F.col(f"p{p}").cast(kind).alias(name) for p, name in enumerate(names)])


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    picks: Mapping[str, Column],
    **cutting,
) -> DataFrame:
    """The values at given 0-based sorted indices, one row per group; NULL values do not count.

    ``picks`` maps an output name to an index written in terms of the group size ``_n``.

    A quantile sketch per group bounds each wanted value, exact counts tell how many are smaller than the bound and
    whether it holds (else it is left open), and only values inside the bounds are shuffled and sorted.
    """
    keys = list(keys)
    if not keys and isinstance(df.schema[by].dataType, NumericType) and not isinstance(df.schema[by].dataType, DecimalType) and not cutting:
        whole = _whole_table(df, by, picks)
        if whole is not None:
            return whole
    number, kind = as_number(F.col(by), df.schema[by].dataType)
    values = df.filter(F.col(by).isNotNull()).select(*keys, F.col(by).alias("_by"), number.alias("_number"))
    real = ~is_nan(F.col("_number"), kind)
    sized = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(real).alias("_real"), quantile_grid(F.col("_number"), kind, GRID, SKETCH).alias("_grid"))
    names = list(picks)
    sized = sized.withColumns({f"_i{p}": picks[name].cast("bigint") for p, name in enumerate(names)})
    ends = {}
    for p in range(len(names)):
        ends[f"_l{p}"], ends[f"_h{p}"] = _interval(F.col(f"_i{p}"), F.col("_grid"), F.col("_real"))
    # a sketch made again may give other bounds, so one is kept
    bounds = checkpointed(sized.withColumns(ends).drop("_grid", "_real"))

    def between(p: int) -> Column:
        low, high = F.col(f"_l{p}"), F.col(f"_h{p}")
        return (low.isNull() | (F.col("_number") >= low)) & (high.isNull() | (F.col("_number") <= high))

    numbers = range(len(names))
    checks = [F.count_if(F.col("_number") < F.col(f"_l{p}")).alias(f"_b{p}") for p in numbers] + [F.count_if(between(p)).alias(f"_c{p}") for p in numbers]
    counted = _with_groups(values.select(*keys, "_number"), bounds, keys).groupBy(*keys).agg(*checks)
    narrowed = join_on_keys(bounds, counted, keys, "inner") if keys else bounds.crossJoin(counted)
    holds = {p: (F.col(f"_i{p}") >= F.col(f"_b{p}")) & (F.col(f"_i{p}") < F.col(f"_b{p}") + F.col(f"_c{p}")) for p in numbers}
    fields = [[F.when(holds[p], F.col(f"_{x}{p}")).alias(f"_{x}{p}") for x in "lh"] + [(F.col(f"_i{p}") - F.when(holds[p], F.col(f"_b{p}")).otherwise(0)).alias(f"_t{p}")] for p in numbers]
    final = narrowed.select(*keys, "_n", *[c for three in fields for c in three])
    wanted = F.array(*[F.when(between(p), F.struct(F.lit(p).alias("_pick"), F.col(f"_t{p}").alias("_at"))) for p in numbers])
    inside = _with_groups(values, final, keys).select(*keys, F.col("_n").alias("_size"), "_by", F.explode(F.filter(wanted, lambda w: w.isNotNull())).alias("_w"))
    inside = checkpointed(inside.select(*keys, "_size", "_w._pick", "_w._at", F.col("_by").alias("_value")))

    counts = value_counts(inside, [*keys, "_size", "_pick", "_at"], "_value", **cutting)
    hit = counts.filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n")))
    return hit.groupBy(*keys).agg(F.max("_size").alias("n"), *[F.max(F.when(F.col("_pick") == p, F.col("_value"))).alias(name) for p, name in enumerate(names)])


def _with_groups(values: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each value with what is known of its group; one row stands for the whole table without keys."""
    return join_on_keys(values, groups, keys, "inner") if keys else values.crossJoin(F.broadcast(groups))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    fractions: Mapping[str, float],
    **cutting,
) -> DataFrame:
    """Exact percentiles with linear interpolation between the two nearest ranks."""
    n1 = F.col("_n") - 1
    picks: dict[str, Column] = {}
    for out, p in fractions.items():
        picks[f"__lo_{out}"] = F.floor(n1 * F.lit(float(p)))
        picks[f"__hi_{out}"] = F.ceil(n1 * F.lit(float(p)))
    stats = order_statistics(df, keys, by, picks, **cutting)
    cols = []
    for out, p in fractions.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{out}").cast("double"), F.col(f"__hi_{out}").cast("double")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(out))
    return stats.select(*keys, "n", *cols)
