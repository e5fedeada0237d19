"""Query on encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.llm.common import table
from motes.llm.pair_index import decode, encode
from motes.llm.registry import query

VOCABULARY = "word_bpe_49k.json"


@query("op12_bpe_pair_index")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of what the ids decode to."""
    path = public_tokenizers.path(VOCABULARY)
    tokens = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"])
    hashed = decode(tokens.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids"), path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return hashed.select("row.doc_id", "row.n_tokens", "row.ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
