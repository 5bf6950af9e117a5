"""Defaults equal the dashboard's values; parameters change results."""

from __future__ import annotations

import inspect

from hydrostar.plans import base, derived
from hydrostar.plans import fixture_params as FX
from hydrostar.plans import params as P
from hydrostar.sources.fixture import fixture_tables
from tests.conftest import SF01


def _default(fn, name):
    return inspect.signature(fn).parameters[name].default


def test_reference_defaults():
    assert _default(base.institution_performance, "min_measurements") == 1000
    assert _default(base.band_distribution, "min_records") == 10
    assert _default(base.state_ranking, "min_plants") == 5
    assert _default(base.monthly_evolution, "year") == 2025
    assert _default(base.monthly_evolution, "min_measurements") == 100
    assert _default(base.monthly_evolution, "period_bounds") == (2, 4)
    assert len(_default(base.band_distribution, "band_pairs")) == 8
    assert len(_default(base.parameter_purpose, "rules")) == 7
    assert _default(derived.top_states, "k") == 10
    assert _default(derived.top_parameters, "k") == 10
    assert _default(derived.top_ranked_states, "k") == 15
    assert P.KPI_NAMES[1] == "ETAs Ativas"


def test_thresholds_change_results(spark):
    t = fixture_tables(spark, SF01)
    assert base.state_ranking(t, min_plants=FX.MIN_RANKED_PLANTS).count() == 12
    assert base.state_ranking(t, min_plants=1).count() == 25
    assert base.institution_performance(t, min_measurements=FX.MIN_INSTITUTION_MEASUREMENTS).count() == 65
    assert base.institution_performance(t).count() == 0
    assert base.monthly_evolution(t, year=FX.MONTHLY_YEAR, min_measurements=FX.MIN_MONTHLY_MEASUREMENTS).count() == 39
    assert base.monthly_evolution(t).count() == 0  # no 2025 data in the fixture
    q8 = base.band_distribution(t, band_pairs=FX.BAND_PAIRS, min_records=FX.MIN_BAND_RECORDS)
    assert q8.count() == 24
