"""Collects the corpus queries."""

import corpus_pipeline
from motes.llm import queries_lm, queries_merkle, queries_packing, queries_similar, queries_text, queries_tokens, queries_trie  # noqa: F401
from motes.llm.registry import QUERIES, SQL

QUERIES["pipeline"] = corpus_pipeline.run

__all__ = ["QUERIES", "SQL"]
