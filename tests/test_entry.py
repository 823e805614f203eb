"""Every query that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from loomquery.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that SQL can't express, and the tests that compare them with brute force.
BY_TEST = {"stemmed_bm25_top10": "tests/test_text.py::test_stemmed_query_by_brute_force"}
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="the tables aren't here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(map(plain, r)) for r in df.collect()]
    if name not in ORACLE:
        path, test = BY_TEST[name].split("::")
        with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), path)) as f:
            assert f"def {test}(" in f.read()
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    at = [want.columns.index(c) for c in df.columns]
    assert len(at) == len(want.columns)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
