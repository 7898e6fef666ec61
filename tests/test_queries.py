"""Every registered query against its oracle on the smallest tables."""

import duckdb
import pytest

from colprism.catalog import ORACLES, QUERIES
from check import TABLES, compare

WITHOUT_ORACLE = set()


@pytest.fixture(scope="module")
def connection(tiny):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, tiny, name):
    text, _, good = compare(spark, connection, name, QUERIES[name], ORACLES.get(name), tiny)
    assert good, text


def test_oracles():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE
