"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for m in map(entry.importlib.import_module, entry.MODULES) for n in m.SQL]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view \"{os.path.basename(path)[:-8]}\" as select * from '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) or type(value).__name__ == "Decimal" else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    mine = entry.queries()[name](spark, DATA)
    sql = con.sql(entry.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(sql.columns)
    order = [sql.columns.index(c) for c in columns]
    assert sorted(tuple(map(plain, (r[c] for c in columns))) for r in mine.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in sql.fetchall())


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
