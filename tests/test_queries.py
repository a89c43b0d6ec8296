"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    assert rows
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.sql(sql)
    expected, columns = result.fetchall(), result.columns
    assert sorted(frame.columns) == sorted(columns)
    assert canonical(rows, frame.columns) == canonical(expected, columns)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["query_id", "rank", "id", "document", "distance", "similarity"]
