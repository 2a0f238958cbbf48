"""Every registered query against its SQL in DuckDB, on the smallest data set."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from annalog.checks import cases

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(r[i]) for i in order) for r in rows)


# Training-data queries without SQL have tests of their own.
NAMES = [n for n in entry.queries() if n in cases.QUERIES or n in entry.oracle_sql()]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    mine = rows_of(df.columns, df.collect())
    if name not in entry.oracle_sql():
        assert mine
        return
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
