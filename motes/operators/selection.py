"""The first n rows by a value, found without ranking the table.

A mergeable quantile sketch encloses the n-th value in a narrow interval, one exact count confirms it,
and only the rows inside are sorted, to find the value and the tie of the n-th row. The selection
itself is then a filter on the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.operators.ordered import ranked
from motes.operators.sketches import as_number, quantile_grid

# Size of the sketch: its rank error is about 0.1 %. Quantiles asked of it, evenly spaced.
SKETCH = 4096
GRID = 1000
SLACK = 0.002
# Rows that are sorted in one task at most; a wider interval is narrowed again.
BORDER = 100_000


@dataclass
class _Interval:
    """Bounds of the n-th value's number (None: open), rows that come before it for sure, rows inside."""

    low: float | None
    high: float | None
    before: int
    inside: int

    def holds(self, number: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (number >= F.lit(self.low))
        return out if self.high is None else out & (number <= F.lit(self.high))


def _narrowed(rows: DataFrame, grid: list | None, n: int, descending: bool, at: _Interval) -> _Interval:
    """An interval inside another one, by a grid of its quantiles and one exact count."""
    if grid is None:
        return at
    number = F.col("_number")
    share = (n - at.before) / at.inside
    share = 1 - share if descending else share
    low = grid[max(0, int((share - SLACK) * GRID))]
    high = grid[min(GRID, int((share + SLACK) * GRID) + 1)]
    sure = number > F.lit(high) if descending else number < F.lit(low)
    inside = (number >= F.lit(low)) & (number <= F.lit(high))
    got = rows.filter(at.holds(number)).agg(F.count_if(sure).alias("sure"), F.count_if(inside).alias("inside")).first()
    before = at.before + got["sure"]
    # where the sketch was off, the interval stays as it was
    return _Interval(low, high, before, got["inside"]) if before < n <= before + got["inside"] else at


def nth_row(df: DataFrame, n: int, by: str, tie: str, descending: bool = False, border: int = BORDER):
    """``by`` and ``tie`` of the n-th row (from 1) that has a value, or None where there are fewer.

    By value, equal values by ``tie`` ascending; NaN is the largest value. ``tie`` is a unique integer.
    """
    number, kind = as_number(F.col(by), df.schema[by].dataType)
    rows = df.filter(F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.col(tie).alias("_tie"), number.alias("_number"))
    looked = [F.count(F.lit(1)).alias("n"), quantile_grid(F.col("_number"), kind, GRID, SKETCH).alias("grid")]
    first = rows.agg(*looked).first()
    if n > first["n"] or n < 1:
        return None
    at, grid = _Interval(None, None, 0, first["n"]), first["grid"]
    while at.inside > border:
        found = _narrowed(rows, grid, n, descending, at)
        # equal numbers are not narrowed any further
        stuck, at = found.inside > at.inside // 2, found
        if stuck:
            break
        if at.inside > border:
            grid = rows.filter(at.holds(F.col("_number"))).agg(looked[1]).first()["grid"]
    between = rows.filter(at.holds(F.col("_number"))).select("_by", "_tie")
    place = n - at.before - 1
    if at.inside <= border:
        order = F.col("_by").desc() if descending else F.col("_by").asc()
        return between.sort(order, "_tie").offset(place).limit(1).first()
    placed = ranked(between, [], "_by", tie="_tie", descending=descending, out="_place")
    return placed.filter(F.col("_place") == place).select("_by", "_tie").first()


def first_rows(df: DataFrame, n: int, by: str, tie: str = "_row", descending: bool = False, border: int = BORDER) -> DataFrame:
    """The ``n`` rows with the lowest (or highest) value of ``by``, equal values by ``tie`` ascending.

    Rows without a value come last. NaN is the largest value. The plan is a filter: no shuffle, no window. Finding
    it reads ``by`` and ``tie`` four times, so a ``df`` that is costly to make is better checkpointed before. ``border``
    is how many rows are sorted in one task at most.
    """
    if n < 1:
        return df.limit(0)
    last = nth_row(df, n, by, tie, descending, border)
    if last is None:
        # all that have a value, and of the others the first by tie
        missing = df.filter(F.col(by).isNull())
        end = nth_row(missing, n - df.filter(F.col(by).isNotNull()).count(), tie, tie, border=border)
        return df if end is None else df.filter(F.col(by).isNotNull() | (F.col(tie) <= F.lit(end["_tie"])))
    value, place = F.col(by), F.lit(last["_by"]).cast(df.schema[by].dataType)
    further = value > place if descending else value < place
    return df.filter(further | ((value == place) & (F.col(tie) <= F.lit(last["_tie"]))))
