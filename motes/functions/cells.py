"""How single cells are read from and written to text tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_text(value: Column, kind: T.DataType, missing: str = "?") -> Column:
    """A cell without white space: ``?`` for missing, 1/0 for booleans, at most six decimals."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, F.lit("1")).when(~value, F.lit("0"))
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        number = value.cast("double")
        usable = ~F.isnan(number) & (F.abs(number) != float("inf"))
        fixed = F.format_string("%.6f", number)
        trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
        text = F.when(usable, F.when(trimmed.isin("-0", ""), F.lit("0")).otherwise(trimmed))
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    else:
        trimmed = F.trim(F.regexp_replace(value.cast("string"), r"\s+", " "))
        text = F.when(trimmed != "", F.translate(trimmed, " ", "_"))
    return F.coalesce(text, F.lit(missing))


def typed(text: Column, kind: str, missing: str = "?") -> Column:
    """A cell as ``kind``; the missing mark and unreadable text become NULL."""
    if kind == "string":
        return F.when(text != missing, text)
    if kind in ("int", "bigint"):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)
