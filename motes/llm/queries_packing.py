"""Query on packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motes.llm.common import table
from motes.llm.packing import pack
from motes.llm.registry import query

VOCABULARY = "word_bpe_49k.json"


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences along the curve."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id"], with_ids=False)
    return pieces.select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
