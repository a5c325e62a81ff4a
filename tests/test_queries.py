"""Every catalogue query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from sigloom import queries as catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    order = [list(want.columns).index(c) for c in cols]
    rows = sorted(str(tuple(shown(r[c]) for c in cols)) for r in got.collect())
    assert rows == sorted(str(tuple(shown(r[i]) for i in order)) for r in want.fetchall())


def test_scored_search_keeps_the_hits(spark):
    scored = catalogue.search_scored(spark, DATA)
    assert scored.count() == catalogue.search_inexact(spark, DATA).count() and scored.where("score is null").count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
