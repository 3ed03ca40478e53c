import duckdb
import pytest

import __spark_entry__ as contract
from check import rows_of
from colscope.plans.tenants import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_entry(spark):
    assert contract.entry(spark).count() == 63


def test_every_oracle_belongs_to_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    found = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name in ORACLES:
        result = database.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(frame.columns) == sorted(columns)
        assert found == rows_of(columns, result.fetchall())
    else:
        assert found
