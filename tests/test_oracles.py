"""Every query with SQL gives DuckDB's rows on the smallest tables; the rest run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple("" if pd.isna(x) else f"{float(x):.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert text(got) == text(want)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and registry.FLAGSHIP in e.queries()
