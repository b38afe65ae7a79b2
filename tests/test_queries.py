"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plain(v):
    if v is None:
        return "N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).count() == 3


def test_keys():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(set(entry_module.oracle_sql())))
def test_same_as_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    got = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted("|".join(plain(r[names.index(c)]) for c in columns) for r in got.fetchall())
