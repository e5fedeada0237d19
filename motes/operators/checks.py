"""Conditions checked inside the plan that delivers the rows, without a job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, condition: Column, message: str | Column) -> DataFrame:
    """``df``; a row that fails ``condition`` (or makes it NULL) stops the job with ``message``.

    A filter, so no later selection of columns can prune the check away.
    """
    error = F.raise_error(F.lit(message) if isinstance(message, str) else message)
    return df.filter(F.when(condition, F.lit(True)).otherwise(error.cast("boolean")))
