"""Every query with SQL gives the same rows as that SQL, on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans import catalog
from loomgraph.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    """pandas turns whole numbers beside nulls into floats."""
    return int(x) if isinstance(x, float) and x.is_integer() else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.where(df.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["degree_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "ReadSchema" in plan
    assert "o_comment" not in plan and "p_retailprice" not in plan and "l_comment" not in plan
