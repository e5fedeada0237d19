"""Run logs and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "event string, timestamp string, iteration string, step string, status string, rc string, t_start string, "
    "t_end string, elapsed_s string, log_path string, cmd string, tag string, hostname string, working_dir string"
)
TIMING_SCHEMA = "iteration string, step string, t_start string, t_end string, elapsed_s int, rc int"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Event lines; malformed or half-written lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def count_malformed(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """How many lines are events and how many are not."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("e")).agg(
        F.count_if(F.col("e._corrupt").isNull()).alias("events"), F.count_if(F.col("e._corrupt").isNotNull()).alias("malformed")
    )


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """Step timings; the result of a step is PASS for return code 0."""
    return spark.read.schema(TIMING_SCHEMA).option("header", "true").csv(path).withColumn(
        "result", F.when(F.col("rc") == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))
    )
