"""The driver's contract, and some queries held against their SQL."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 75


@pytest.mark.parametrize("name", ["closing_book_pivot", "demargin_all_long", "match_odds", "asian_handicap", "murphy", "bh_qvalues", "gradient_by_team", "coverage_matrix", "dm_table", "paired_calibration"])
def test_against_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    keys = [c for c in cols if not pd.api.types.is_float_dtype(got[c])] + [c for c in cols if pd.api.types.is_float_dtype(got[c])]
    a, b = (x[cols].sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if pd.api.types.is_float_dtype(a[c]):
            assert ((a[c] - b[c].astype(float)).abs().fillna(0) <= 2e-6).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
