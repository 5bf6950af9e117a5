"""The correctness gate, locally: every registered query against its DuckDB
oracle on the sf0.01 tables (values, row counts, column names, order)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from hydrostar.plans import catalog
from tests.conftest import SF01

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    assert key in ORACLES, f"{key} has no oracle"
    df = QUERIES[key](spark, SF01)
    got = [tuple(_norm(x) for x in r) for r in df.collect()]
    rel = con.sql(ORACLES[key])
    assert sorted(df.columns) == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in df.columns]
    want = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    assert len(got) == len(want)
    assert got == want  # same rows in the same order


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 60  # every region-month of 1997 at sf0.001
    assert df.columns == [
        "region_name",
        "month",
        "measurements",
        "plants",
        "parameters",
        "intensity",
        "diversity",
        "period",
    ]


def test_defining_queries_runs_no_job(spark):
    """Every plan is built without a job; jobs belong to actions.  (Queries on
    a written store are apart: writing it takes jobs.)"""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("defining", "no job expected")
    try:
        for key, (fn, _) in catalog.REGISTRY.items():
            fn(spark, SF01)
            assert not tracker.getJobIdsForGroup("defining"), key
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
