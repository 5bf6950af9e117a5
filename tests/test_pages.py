"""Result reuse (S3) and the page bundles: same rows as the registered
queries, base queries materialised once, lineage cut at the store."""

from __future__ import annotations

import pytest

from hydrostar.plans import catalog
from hydrostar.plans.pages import PAGES, page, result
from hydrostar.plans.reuse import ResultStore
from hydrostar.sources.fixture import fixture_tables
from tests.conftest import SF001
from tests.frames import bundle

PARAMS = {
    "Q2": catalog.Q2_KW,
    "Q7": catalog.Q7_KW,
    "Q8": catalog.Q8_KW,
    "Q9": catalog.Q9_KW,
    "Q10": catalog.Q10_KW,
    "P5": catalog.P5_KW,
    "P13": dict(k=catalog.FX.TOP_RANKED_STATES),
    "P18": catalog.P18_KW,
    "P24c": catalog.P18_KW,
}


def _want(spark, rid: str):
    """The registered query of an id, with the page's parameters."""
    if rid == "P22b":  # registered for another year than the page shows
        return result(rid, fixture_tables(spark, SF001), PARAMS)
    (key,) = [k for k, i in catalog.IDS.items() if i == rid]
    return catalog.queries()[key](spark, SF001)


@pytest.fixture(scope="module")
def store(spark):
    return ResultStore(spark)


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page_matches_registered_queries(spark, store, name):
    t = fixture_tables(spark, SF001)
    results = page(name, t, store, PARAMS)
    assert list(results) == list(PAGES[name])
    for rid, df in results.items():
        want = _want(spark, rid)
        assert df.columns == want.columns, rid
        assert [tuple(r) for r in df.collect()] == [tuple(r) for r in want.collect()], rid


def test_store_materialises_once_and_cuts_lineage(spark):
    t = fixture_tables(spark, SF001)
    store = ResultStore(spark)
    first = page("temporal", t, store, PARAMS)
    second = page("temporal", t, store, PARAMS)
    assert first["Q10"] is second["Q10"]
    plan = second["P23"]._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan  # derived results read the stored Q10
    store.clear()
    assert not store._results


def test_store_never_returns_another_bundles_rows(spark):
    """A freed bundle's identity may be reused; its results must not be."""
    store = ResultStore(spark)
    for n in (3, 0, 2, 5):
        plants = [(k, 1, 1, f"F{k}") for k in range(n)]
        t = bundle(spark, plant=plants)
        assert page("infrastructure", t, store)["Q1"].count() == n
        del t
