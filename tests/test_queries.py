"""Every query with SQL gives the rows that DuckDB gives for it on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cmdlake import catalog

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def plain(x):
        return None if x is pd.NA or x is None or isinstance(x, float) and math.isnan(x) else x

    names = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]
    assert len(got)
