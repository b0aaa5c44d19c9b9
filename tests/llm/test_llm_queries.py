"""Queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from cmdlake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = list(got.columns)
    assert sorted(map(tuple, got[names].astype(str).to_numpy())) == sorted(map(tuple, want[names].astype(str).to_numpy()))
    assert len(got)
