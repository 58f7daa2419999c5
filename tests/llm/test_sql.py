"""Queries that SQL can express against DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from rastermill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(map(tuple, ours[columns].itertuples(index=False))) == sorted(map(tuple, theirs[columns].itertuples(index=False)))
