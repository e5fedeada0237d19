"""Every ready-made query against its SQL twin, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("MOTES_TEST_TABLES", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, twin, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    if name not in entry.oracle_sql():
        assert mine
        return
    result = twin.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert sorted(names) == columns
    assert {c: kinds[c] for c in columns} == {c: TYPES[t] for c, t in df.dtypes}
    order = [names.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 750
