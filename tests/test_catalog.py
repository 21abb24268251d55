"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandline import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        x = float(v)
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_has_a_query_for_each_name():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
