"""Every registered query beside its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in entry.oracle_sql():
        assert got
        return
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, cursor.fetchall())


def test_keys_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
