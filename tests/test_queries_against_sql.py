"""Every registered query with SQL gives the same rows as that SQL on the small tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of

# the pipeline operators have tests of their own
OTHERS = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in entry.queries().items() if not OTHERS.match(k)}
SQL = {k: v for k, v in entry.oracle_sql().items() if not OTHERS.match(k)}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows(spark, duck, small, key):
    df = QUERIES[key](spark, small)
    result = duck.execute(SQL[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, got) == rows_of(names, result.fetchall())
