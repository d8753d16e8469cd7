"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from logquarry.workloads.oracle import ORACLE
from logquarry.workloads.queries import QUERIES

pytestmark = pytest.mark.skipif(not Path(entry.SMOKE_DATA).exists(), reason="no test tables")
TABLES = "events documents conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{entry.SMOKE_DATA}/{name}.parquet'")
    return connection


def rows(df):
    def cell(value):
        if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
            return ""
        return f"{float(value):.6f}" if isinstance(value, (int, float)) or hasattr(value, "dtype") else str(value)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, row)) for row in df.itertuples(index=False))


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    expected = rows(sql.execute(ORACLE[name]).fetch_df())
    assert rows(QUERIES[name](spark, entry.SMOKE_DATA).toPandas()) == expected


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "type", "timestamp", "body"]
