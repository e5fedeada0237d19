"""Words, rows and batches shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a word ends at a blank, tab, line feed, vertical tab, form feed or carriage return;
# ``bytes.split()`` of UTF-8 text cuts at the same six characters
BLANKS = r"[\x20\x09-\x0D]+"

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null and for blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    """Number of words, without an array of them: places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boxed(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one struct, so that helper columns can't clash with the caller's."""
    return df.select(F.struct("*").alias(name))


def row_and(boxed_row: DataFrame, fields: str, name: str = "row"):
    """The schema of ``name`` as it is in ``boxed_row``, followed by ``fields`` (DDL)."""
    from pyspark.sql.types import StructType

    return StructType([boxed_row.schema[name], *StructType.fromDDL(fields).fields])
