"""Cross-query invariants on the sf0.01 tables."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hydrostar.plans import base, derived
from hydrostar.plans import fixture_params as FX
from hydrostar.sources.fixture import fixture_tables
from tests.conftest import SF01


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF01)


@pytest.fixture(scope="module")
def q10(t):
    return base.monthly_evolution(t, year=FX.MONTHLY_YEAR, min_measurements=FX.MIN_MONTHLY_MEASUREMENTS)


def test_band_shares_bounded(t):
    q8 = base.band_distribution(t, band_pairs=FX.BAND_PAIRS, min_records=0).collect()
    sums = defaultdict(float)
    for r in q8:
        sums[(r.filtration_type, r.parameter_name)] += r.pct
    assert sums and all(abs(v - 100.0) <= 0.05 for v in sums.values())  # no band dropped
    kept = base.band_distribution(t, band_pairs=FX.BAND_PAIRS, min_records=FX.MIN_BAND_RECORDS)
    sums = defaultdict(float)
    for r in kept.collect():
        sums[(r.filtration_type, r.parameter_name)] += r.pct
    assert all(v <= 100.05 for v in sums.values())


def test_filtration_shares_and_totals(t):
    q1 = base.filtration_share(t).collect()
    assert sum(r.pct for r in q1) <= 100.0
    p3 = derived.filtration_total(base.filtration_share(t)).first().plants
    blank = t.plant.filter(F.col("filtration_type").isNull() | (F.col("filtration_type") == "")).count()
    kpis = {r.metric: r.value for r in base.kpi_summary(t).collect()}
    assert p3 + blank == kpis["ETAs Ativas"]


def test_region_share_sums_to_geo(t):
    q6 = base.geo_activity(t)
    total = q6.agg(F.sum("measurements")).first()[0]
    assert derived.region_share(q6).agg(F.sum("measurements")).first()[0] == total


def test_monthly_derivatives(q10):
    total = q10.agg(F.sum("measurements")).first()[0]
    assert derived.period_summary(q10).agg(F.sum("measurements")).first()[0] == total
    cells = derived.intensity_heatmap(q10).collect()
    filled = sum(1 for r in cells for c in derived.MONTH_COLUMNS if r[c] is not None)
    assert filled == q10.count()
    series = derived.monthly_series(q10)
    assert series.count() == 2 * q10.count()


def test_geo_plants_bounded_by_coverage(t):
    cover = {r.state_code: r.plants for r in base.state_coverage(t).collect()}
    for r in base.geo_activity(t).collect():
        assert r.plants <= cover[r.state_code]


def test_hierarchy_levels(t):
    q5 = base.parameter_volume(t)
    h = derived.category_hierarchy(q5)
    total = q5.agg(F.sum("measurements")).first()[0]
    by_level = {r.level: r.s for r in h.groupBy("level").agg(F.sum("measurements").alias("s")).collect()}
    assert by_level == {0: total, 1: total, 3: total}
