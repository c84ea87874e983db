"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lectern.plans import registry


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value if value is None or isinstance(value, (int, bool)) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
