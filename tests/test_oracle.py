"""Every query that has SQL gives the same rows in Spark and DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from workloads.tables import TABLE_NAMES

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(repr(r) for r in cursor.fetchall())
    found = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert found == expected


@pytest.mark.parametrize("name", ["discover_tables", "file_manifest", "data_fingerprint", "batch_score", "train_logistic"])
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
