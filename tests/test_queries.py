"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from fieldstrata.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
