"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from isoline.plans import registry
from isoline.plans.derive import derived


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, small, duck, name):
    got, want = registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(_plain(got), _plain(want))


#: Queries without SQL: rounds that go on until nothing meets, which test_operators holds against plain rounds.
BY_HAND = {"box_merge", "box_gaps", "bridged_bends", "bridged_valves"}


def test_queries_without_sql_are_tested_by_hand(spark, small):
    assert set(registry.QUERIES) - set(registry.SQL) == BY_HAND
    boxes = derived(spark, small, "d_boxes")
    for name, coarse in (("box_merge", "equipment"), ("box_gaps", "instrument")):
        got = registry.QUERIES[name](spark, small)
        assert got.agg({"n_boxes": "sum"}).first()[0] == boxes.where(f"coarse = '{coarse}'").count()
    for name in ("bridged_bends", "bridged_valves"):
        assert registry.QUERIES[name](spark, small).agg({"n_runs": "sum"}).first()[0] == derived(spark, small, "d_runs").count()
