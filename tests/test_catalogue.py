"""Every query with SQL, against DuckDB on the small tables; the others must give rows of a fixed schema."""

import math

import duckdb
import pandas as pd
import pytest

from granary.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return int(v) if hasattr(v, "__index__") else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    got, want = rows(catalogue.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(catalogue.SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["best_per_day"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_totalprice,200000.0)" in plan and "o_orderpriority" not in plan
