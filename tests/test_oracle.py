"""Every named query against its SQL in DuckDB over the same tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from fraudspark.plans.fixtures import TABLES

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir)
    theirs = duck.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert table(ours.columns, ours.collect()) == table(columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
