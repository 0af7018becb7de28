"""Every query against its SQL twin in DuckDB, on the same tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from lodestack.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>"):
        return "null"
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(v) for v in value])
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    try:
        return f"{float(value):.6f}"
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, sf, name):
    got, want = rows(catalogue.QUERIES[name](spark, sf).toPandas()), rows(duck.execute(catalogue.SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
