"""Registered queries with SQL give DuckDB's rows on the smallest tables: every fifth one, all with EMBERLANE_ALL=1."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from emberlane.plans import reference

SMALL = "/root/testdata/sf0.001"
SQL = reference.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("EMBERLANE_ALL") else sorted(SQL)[::5])
def test_query_matches_sql(spark, duck, name):
    df = reference.queries()[name](spark, SMALL)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=str)
    assert rows(df.select(*(df[c] for c in columns)).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_names_are_unique_and_described():
    assert set(SQL) <= set(reference.queries())
