import os

import pytest

import corpus_pipeline as cp
from tests.llm.helpers import awkward, nothing
from tests.llm.test_similar import brute_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, nothing(spark), "").count() == 0, name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_each_stage_on_its_input(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    rows = [(r.doc_id, r.text) for r in kept["quality"].collect()]
    alone = {c for _, _, c in brute_groups(rows, 5, 80)}
    assert {r.doc_id for r in kept["near_dedup"].collect()} == alone
    assert not kept["personal_data"].filter("text LIKE '%@%.example.com%'").count()
    assert {r.doc_id for r in kept["mixing"].select("doc_id").distinct().collect()} <= alone
    pieces = kept["packing"]
    assert pieces.selectExpr("sum(length)").first()[0] == kept["packing"].filter("start = 0").selectExpr("sum(doc_tokens)").first()[0]
