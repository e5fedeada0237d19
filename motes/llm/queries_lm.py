"""Query on language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.llm.common import table
from motes.llm.lm_scoring import lm_scores
from motes.llm.registry import query


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return lm_scores(docs, held_out).withColumnRenamed("id", "doc_id")
