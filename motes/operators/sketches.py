"""Mergeable quantile sketches of values of any sortable type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, DateType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType


def as_number(value: Column, kind: DataType) -> tuple[Column, str]:
    """A number that never falls where the value rises, and its type."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType, BooleanType)):
        return value.cast("bigint"), "bigint"
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("bigint"), "bigint"
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")), "bigint"
    if isinstance(kind, StringType):
        # the first seven bytes
        return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint"), "bigint"
    return value.cast("double"), "double"


def is_nan(value: Column, kind: str) -> Column:
    return F.coalesce(F.isnan(value), F.lit(False)) if kind == "double" else F.lit(False)


def quantile_grid(value: Column, kind: str, size: int, sketch: int) -> Column:
    """``size + 1`` evenly spaced quantiles of a sketch of the values; NULL without values. NaN does not count."""
    make, get = (F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint) if kind == "bigint" else (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double)
    # one constant instead of a thousand
    ranks = F.split(F.lit(",".join(repr(i / size) for i in range(size + 1))), ",").cast("array<double>")
    some = F.count_if(value.isNotNull() & ~is_nan(value, kind)) > 0
    return F.when(some, get(make(value, F.lit(sketch)), ranks))
