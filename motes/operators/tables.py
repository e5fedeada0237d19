"""Column edits, filters, splits, samples, sorts and set operations on particle tables.

Tables carry ``_row``, the file order, because DataFrames have none.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.operators.checks import require
from motes.operators.ordered import percentiles
from motes.operators.selection import first_rows


# --- columns ---------------------------------------------------------------


def drop_like(df: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Drop columns by exact name, or by prefix when the pattern ends in ``*``."""
    gone = [c for c in df.columns if any(c.startswith(p[:-1]) if p.endswith("*") else c == p for p in patterns)]
    return df.drop(*gone)


def set_by_row(df: DataFrame, other: DataFrame, columns: Sequence[str], order: str = "_row") -> DataFrame:
    """Add or overwrite columns with another table's values at the same row number.

    Tables of different length do not line up, which is an error.
    """
    mine = df.drop(*columns).withColumn("_mine", F.lit(True))
    theirs = other.select(order, *columns, F.lit(True).alias("_theirs"))
    both = require(mine.join(theirs, order, "full_outer"), F.col("_mine") & F.col("_theirs"), "a row number is in one table only")
    return both.drop("_mine", "_theirs")


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    other = {a: b, b: a}
    return df.select(*[F.col(c).alias(other.get(c, c)) for c in df.columns])


def number_rows(df: DataFrame, out: str, order: str = "_row") -> DataFrame:
    return df.withColumn(out, F.col(order) + 1)


def fill_missing_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add columns that do not exist yet with a constant."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def project(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """Exactly these columns in this order; missing ones are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns])


def trim_dimension(dimension: DataFrame, fact: DataFrame, protected: Iterable[str]) -> DataFrame:
    """Drop from a dimension every column the fact table has too, except protected ones."""
    return dimension.drop(*[c for c in dimension.columns if c in set(fact.columns) - set(protected)])


# --- filters, splits, samples ----------------------------------------------


def keep_equal(df: DataFrame, column: str, value: object, numeric: bool = False) -> DataFrame:
    """Keep rows equal to ``value``, compared as text or as numbers."""
    cell = F.col(column)
    if numeric:
        return df.filter(cell.cast("string").try_cast("double") == F.lit(float(value)))
    return df.filter(cell.cast("string") == F.lit(str(value)))


def drop_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Drop rows equal to ``value``; NULL rows stay."""
    return df.filter(~F.col(column).cast("string").eqNullSafe(F.lit(str(value))))


def keep_jobs(df: DataFrame, classes: Sequence, subsets: Sequence, class_col="class", subset_col="subset") -> DataFrame:
    return df.filter(F.col(class_col).isin(list(classes)) & F.col(subset_col).isin(list(subsets)))


def split_halves(df: DataFrame, subset_col: str = "subset") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(subset_col) == 1), df.filter(F.col(subset_col) == 2)


def contiguous_blocks(df: DataFrame, k: int, order: str = "_row", out: str = "block") -> DataFrame:
    """Split 0-based row numbers into ``k`` blocks of floor(n/k); the remainder joins block 0."""
    n = df.count()
    if n < k:
        raise ValueError(f"cannot cut {n} rows into {k} blocks")
    block = F.floor(F.col(order) / F.lit(n // k))
    return df.withColumn(out, F.when(block < k, block).otherwise(F.lit(0)).cast("int"))


def _draw(key: Column, seed: int) -> Column:
    """Reproducible uniform text per key: the same on any cluster and partitioning."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, key: str = "_row", seed: int = 0, **narrowing) -> DataFrame:
    """``n`` random rows, the same for the same seed; ``_row`` keeps the file order."""
    # 13 hex digits are exact in a double; equal draws are ordered by the key
    drawn = df.withColumn("_draw", F.conv(F.substring(_draw(F.col(key), seed), 1, 13), 16, 10).cast("double"))
    return first_rows(drawn, n, "_draw", tie=key, **narrowing).drop("_draw")


def random_halves(df: DataFrame, key: str = "_row", seed: int = 0, out: str = "subset") -> DataFrame:
    """Assign 1 or 2 at random, the same for the same seed."""
    first = F.substring(_draw(F.col(key), seed), 1, 1)
    return df.withColumn(out, F.when(first < "8", F.lit(1)).otherwise(F.lit(2)))


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Read columns as numbers and keep rows where all are finite."""
    cast = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
    for c in columns:
        cast = cast.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return cast


def outlier_fence(df: DataFrame, column: str, **cutting) -> DataFrame:
    """Keep values within 1.5 spreads of the 10th and 70th percentiles."""
    q = percentiles(df, [], column, {"q1": 0.1, "q3": 0.7}, **cutting)
    spread = F.col("q3") - F.col("q1")
    fence = q.select(F.struct((F.col("q1") - 1.5 * spread).alias("low"), (F.col("q3") + 1.5 * spread).alias("high"))).scalar()
    return df.filter((F.col(column) >= fence["low"]) & (F.col(column) <= fence["high"]))


def finite_images(df: DataFrame, pixels: str = "px") -> tuple[DataFrame, DataFrame]:
    """Images with only finite pixels, and the rejected rest with a reason."""
    bad = F.exists(pixels, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(~bad), df.filter(bad).drop(pixels).withColumn("reason", F.lit("non-finite pixel"))


def finite_pixels(df: DataFrame, pixels: str = "px") -> DataFrame:
    """Replace non-finite pixels by zero."""
    good = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
    return df.withColumn(pixels, F.transform(pixels, good))


# --- sorts and sets --------------------------------------------------------


def sort_rows(df: DataFrame, column: str, descending: bool = False, numeric: bool = True, order: str = "_row") -> DataFrame:
    """Stable sort; text that is not a number is an error when ``numeric``."""
    key = F.col(column).cast("double") if numeric else F.col(column)
    return df.orderBy(key.desc() if descending else key.asc(), order)


def concat_by_position(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Append tables under the first one's header, column by column position."""
    out = first
    for df in rest:
        out = out.union(df)
    return out


def concat_by_name(first: DataFrame, *rest: DataFrame) -> DataFrame:
    out = first
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace rows whose key comes again, append the others."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_with_optics(
    particles: DataFrame, optics: DataFrame, new_particles: DataFrame, new_optics: DataFrame, name: str
) -> tuple[DataFrame, DataFrame]:
    """Append particles; optics rows join only when their name is new."""
    added = new_optics.join(optics.select(name).distinct(), name, "left_anti")
    return particles.unionByName(new_particles), optics.unionByName(added)
