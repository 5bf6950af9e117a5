"""Plan-shape checks: no cartesian products, no Python UDFs,
one fact scan for the band query, filters reach the scan."""

from __future__ import annotations

import os

import pytest

from hydrostar.plans import base, catalog, derived
from hydrostar.plans import fixture_params as FX
from hydrostar.sources.fixture import fixture_tables
from hydrostar.sources.tables import load_tables
from tests.conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_no_cartesian_or_python(spark, key):
    text = plan_text(catalog.queries()[key](spark, SF001))
    for op in FORBIDDEN:
        assert op not in text, f"{key}: {op}"


def test_band_distribution_scans_fact_once(spark):
    t = fixture_tables(spark, SF001)
    text = plan_text(base.band_distribution(t, band_pairs=FX.BAND_PAIRS))
    assert text.count("lineitem.parquet") == 1


def test_native_tables_prune_year_partitions(spark, tmp_dir):
    t = fixture_tables(spark, SF001)
    for name in ("region", "state", "municipality", "office", "institution", "plant", "point",
                 "parameter", "band"):
        getattr(t, name).write.parquet(os.path.join(tmp_dir, f"{name}.parquet"))
    t.measurement.write.partitionBy("year").parquet(os.path.join(tmp_dir, "measurement.parquet"))
    native = load_tables(spark, tmp_dir)
    df = base.monthly_evolution(native, year=FX.MONTHLY_YEAR, min_measurements=1)
    text = plan_text(df)
    assert "PartitionFilters: [isnotnull(year" in text and "= 1997)" in text
    fixture = base.monthly_evolution(t, year=FX.MONTHLY_YEAR, min_measurements=1)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, fixture.collect()))


def test_parameter_names_pushed_to_scan(spark, tmp_dir):
    t = fixture_tables(spark, SF001)
    for name in ("region", "state", "municipality", "office", "institution", "plant", "point",
                 "parameter", "band", "measurement"):
        getattr(t, name).write.parquet(os.path.join(tmp_dir, f"{name}.parquet"))
    native = load_tables(spark, tmp_dir)
    text = plan_text(base.band_distribution(native, band_pairs=FX.BAND_PAIRS))
    assert "PushedFilters: [In(parameter_name, [blue anvil,old bolt,red ring])" in text
    assert "PushedFilters: [In(band_name, [A,N,R])" in text


def test_fact_pre_aggregated_before_dimension_joins(spark):
    t = fixture_tables(spark, SF001)
    plan = base.geo_activity(t)._jdf.queryExecution().optimizedPlan().toString()
    # the first aggregate over the fact groups by plant only
    assert "Aggregate [plant_id" in plan


def test_native_csv_tables_load_and_query(spark, tmp_dir):
    t = fixture_tables(spark, SF001)
    for name in ("region", "state", "municipality", "office", "institution", "plant", "point",
                 "parameter", "band", "measurement"):
        getattr(t, name).write.option("header", True).csv(os.path.join(tmp_dir, f"{name}.csv"))
    native = load_tables(spark, tmp_dir, "csv")
    def types(df):
        return [(f.name, f.dataType) for f in df.schema.fields]

    assert types(native.measurement) == types(t.measurement)
    got = sorted(map(tuple, base.geo_activity(native).collect()))
    want = sorted(map(tuple, base.geo_activity(t).collect()))
    assert got == want


def test_bigint_year_is_pushed_to_the_scan(spark, tmp_dir):
    """Files with INT or BIGINT years: the equality reaches the scan."""
    t = fixture_tables(spark, SF001)
    for kind in ("int", "bigint"):
        folder = os.path.join(tmp_dir, kind)
        for name in ("region", "state", "municipality", "office", "institution", "plant", "point",
                     "parameter", "band"):
            getattr(t, name).write.parquet(os.path.join(folder, f"{name}.parquet"))
        fact = t.measurement.withColumn("year", t.measurement["year"].cast(kind))
        fact.write.parquet(os.path.join(folder, "measurement.parquet"))
        native = load_tables(spark, folder)
        df = base.monthly_evolution(native, year=FX.MONTHLY_YEAR, min_measurements=1)
        assert "EqualTo(year,1997)" in plan_text(df), kind
        assert df.count() == 60


def test_resorted_results_sort_once(spark):
    """No global sort of the base query survives below a result that sorts."""
    for key in ("P17_select_options", "P20_intensity_heatmap"):
        assert plan_text(catalog.queries()[key](spark, SF001)).count("Exchange rangepartitioning") == 1


def _below_fact_rollup(df) -> str:
    """The optimized plan between the fact's aggregate and its scan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    fact = plan[: plan.index("l_linenumber")].rindex("Aggregate [")
    return plan[fact : plan.index("l_linenumber")]


def test_band_query_rolls_up_only_listed_rows(spark):
    """Small lists of ids filter the fact scan; no other join is below the
    rollup."""
    t = fixture_tables(spark, SF001)
    below = _below_fact_rollup(base.band_distribution(t, band_pairs=FX.BAND_PAIRS))
    assert below.count("Join LeftSemi") == 2 and below.count("Join") == 2


def test_band_query_combines_the_fact_first_where_lists_are_large(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = fixture_tables(spark, SF001)
        df = base.band_distribution(t, band_pairs=FX.BAND_PAIRS)
        assert "Join" not in _below_fact_rollup(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_query_defines_only_the_tables_it_reads(spark):
    t = fixture_tables(spark, SF001)
    base.filtration_share(t)
    assert "plant" in vars(t) and "measurement" not in vars(t) and "office" not in vars(t)


def test_pages_name_every_derived_result():
    from hydrostar.plans.pages import PAGES

    shown = {r for ids in PAGES.values() for r in ids}
    assert shown >= set(derived.DERIVED_ON)
