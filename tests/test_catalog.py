"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lattica import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_oracle(spark, name):
    first, again = (catalog.queries()[name](spark, str(DATA)).toPandas() for _ in range(2))
    assert len(first) and rows(first) == rows(again)


def test_differences_of_whole_tables(spark):
    customer = spark.read.parquet(str(DATA / "customer.parquet"))
    got = catalog.queries()["result_differences_whole"](spark, str(DATA))
    dropped = customer.where("c_mktsegment = 'BUILDING'")
    missing = got.where("side = 'left' and c_mktsegment = 'BUILDING'")
    assert sorted(r[0] for r in missing.select("c_custkey").collect()) == sorted(str(r[0]) for r in dropped.select("c_custkey").collect())
    repeated = customer.where("c_mktsegment = 'MACHINERY'").count()
    assert got.where("side = 'right' and c_mktsegment = 'MACHINERY'").count() == repeated
