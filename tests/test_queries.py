"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(table, names):
    """Rows as typed tuples, in an order that nulls do not upset."""
    return sorted((tuple(r[c] for c in names) for r in table.to_pylist()), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    got = entry.queries()[name](spark, DATA).toArrow()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names)
    assert rows(got, names) == rows(want, names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
