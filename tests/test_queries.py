"""Every query against its SQL on the smallest tables, and the entry point."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusloom import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return f"{float(value):.6g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, (tuple(plain(v) for v in r) for r in frame.itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, sf, duck, name):
    got, want = core.QUERIES[name](spark, sf).toPandas(), duck.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, sf, name):
    assert core.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
