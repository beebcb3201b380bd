"""Every registered query with SQL equals DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from gaugeworks.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(x):
    if x is None or type(x).__name__ in ("NaTType", "NAType") or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6)
    return x.item() if hasattr(x, "item") and not isinstance(x, str) else x


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(map(norm, r)) for r in df[columns].itertuples(index=False)), key=repr), columns


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
