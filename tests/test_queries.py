"""Every query with SQL against DuckDB on the same tables: names, rows, values."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.01")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "fraud_count", "approved", "fraud_score", "response"] and df.count() > 5
