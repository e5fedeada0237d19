"""Queries on similar documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.llm.common import table
from motes.llm.exact_substrings import without_repeats
from motes.llm.near_dedup import near_duplicates
from motes.llm.prefix_forest import nearest
from motes.llm.registry import query


@query("op9_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents, on four words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, words=4)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


@query("op8_exact_substrings")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings that recur, and how many of their words lie
    in passages of over 50 words that another document has too."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], words=51)
    return found.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_shared_words")


@query("op5_prefix_forest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth, among all."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
