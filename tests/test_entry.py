"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.compare import rows_of

SQL = entry_module.oracle_sql()
CORE = [n for m in entry_module._MODULES if not m.__name__.startswith("lodesieve.llm") for n in m.queries()]
SLOW = {"model_scores", "model_quality"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["table_name", "record_key", "ref_field", "orphan_kind", "ref_period"] and df.count() > 0


@pytest.mark.parametrize("name", [n for n in CORE if n not in SLOW])
def test_query(spark, sf, con, name):
    got = entry_module.queries()[name](spark, sf).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
