"""Corpus queries against their SQL twins, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from motes.llm.catalog import QUERIES, SQL

FOLDER = os.environ.get("MOTES_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_registered():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert mine == sorted(repr(tuple(r)) for r in theirs)
