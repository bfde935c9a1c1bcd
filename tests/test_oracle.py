"""Every query of the engine with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from sparkwell.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
