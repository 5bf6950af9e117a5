"""Registered queries against their DuckDB oracles, and what is registered."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as E
from hydrostar.llm import queries as Q
from tests.conftest import SF01

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("key", sorted(Q.ORACLES))
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = Q.QUERIES[key](spark, SF01)
    want = con.sql(Q.ORACLES[key])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_one_query_an_operator():
    numbers = [int(re.match(r"op(\d+)_", k)[1]) for k in Q.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(Q.QUERIES) | {"pipeline"} <= set(E.queries())
