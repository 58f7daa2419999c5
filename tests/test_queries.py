"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from rastermill import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def ordered(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if pd.isna(v) else str(float(v)) if not isinstance(v, str) else v for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q in queries.ORACLE_SQL])
def test_against_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert ordered(ours) == ordered(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_order_match(spark):
    r = queries.QUERIES["order_match"](spark, SF).first()
    assert (r["max_x"], r["max_y"]) == (1, 40)
