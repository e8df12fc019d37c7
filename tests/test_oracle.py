"""Every query with SQL against DuckDB on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from codebrook import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.3f}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(plain(r[i])) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    got = df.collect()
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())
