"""The written store: same rows as the plain tables, no shuffle between the
fact grain and the grouping by plant, proofs both ways, statistics."""

from __future__ import annotations

import os

import pytest

from hydrostar.plans import base, catalog
from hydrostar.sources.fixture import fixture_tables
from hydrostar.operators.rollup import GRAIN, fact_rollup
from hydrostar.sources.gold import (
    ROWS_A_BUCKET,
    RepeatedKeys,
    buckets_of,
    enrich_measurements,
    load_gold,
    write_gold,
)
from hydrostar.sources.keys import MAX_BITS, Keys, verify
from tests.conftest import SF001
from tests.frames import bundle, geo
from tests.test_copies import _data

QUERIES = {
    "Q4": (base.point_volume, {}),
    "Q5": (base.parameter_volume, {}),
    "Q6": (base.geo_activity, {}),
    "Q7": (base.institution_performance, dict(min_measurements=5)),
    "Q8": (base.band_distribution, catalog.Q8_KW | dict(min_records=1)),
    "Q9": (base.state_ranking, dict(min_plants=2)),
    "Q10": (base.monthly_evolution, catalog.Q10_KW | dict(min_measurements=1)),
    "Q11": (base.kpi_summary, {}),
}


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    return str(tmp_path_factory.mktemp("gold") / "store")


@pytest.fixture(scope="module")
def gold(spark, path):
    return write_gold(fixture_tables(spark, SF001), path, buckets=4)


@pytest.mark.parametrize("qid", sorted(QUERIES))
def test_same_rows_as_the_plain_tables(spark, gold, qid):
    fn, kw = QUERIES[qid]
    want = rows(fn(fixture_tables(spark, SF001), **kw))
    assert want and rows(fn(gold, **kw)) == want


def up_to_scan(plan: str) -> list[str]:
    """Operators from the fact's scan up to the root, nearest first."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "_grain" in line and "Scan" in line)
    depth, out = len(lines[at]), []
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-*"))
        if here < depth:
            depth = here
            out.append(line.strip(" :+-*"))
    return out


@pytest.mark.parametrize("qid", ["Q6", "Q7", "Q9", "Q10"])
def test_no_shuffle_between_the_grain_and_its_aggregate(gold, qid):
    fn, kw = QUERIES[qid]
    plan = plan_of(fn(gold, ordered=False, **kw))
    above = up_to_scan(plan)
    full = next(k for k, op in enumerate(above) if "HashAggregate(keys=[plant_id" in op and "partial" not in op)
    assert not [op for op in above[:full] if op.startswith("Exchange")]
    assert plan.count("_grain") == 1 or plan.count("FileScan") == 1
    assert "Join" not in plan


def test_monthly_query_reads_one_year_of_the_grain(gold):
    plan = plan_of(base.monthly_evolution(gold, **catalog.Q10_KW))
    assert "PartitionFilters: [isnotnull(year" in plan


def test_later_session_loads_the_store(spark, gold, path):
    other = spark.newSession()
    for key, value in (("spark.sql.ansi.enabled", "true"), ("spark.sql.session.timeZone", "UTC")):
        other.conf.set(key, value)
    again = load_gold(other, path)
    assert again.keys == gold.keys
    assert rows(base.geo_activity(again)) == rows(base.geo_activity(gold))


def test_store_is_registered_anew_where_the_catalog_is_empty(spark, gold, path):
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("gold_")]
    want = rows(base.state_ranking(gold))
    for name in tables:
        spark.sql(f"DROP TABLE {name}")  # external: the files stay
    again = load_gold(spark, path)
    assert rows(base.state_ranking(again)) == want
    assert "Exchange" not in " ".join(
        up_to_scan(plan_of(base.state_ranking(again, ordered=False)))[:2]
    )


def test_repeated_keys_are_not_enriched(spark, tmp_path):
    t = bundle(spark, **_data())
    with pytest.raises(RepeatedKeys, match="state"):
        write_gold(t, str(tmp_path / "no"), buckets=2)
    assert not os.path.exists(tmp_path / "no")


def test_orphans_keep_their_row(spark):
    t = bundle(
        spark,
        **geo(2),
        municipality=[(1, 1), (2, 9)],
        plant=[(1, 1, None, "A"), (2, 2, 5, "B"), (3, 8, None, None)],
        parameter=[(1, "pH", None, None)],
        measurement=[(k, p, 1, q, 1, 1.0, 1, 2025) for k, (p, q) in enumerate([(1, 1), (2, 1), (3, 7), (4, 1), (None, None)])],
    )
    t = t.having(keys=verify(t))
    found = enrich_measurements(t.measurement, t).orderBy("measurement_id")
    got = rows(found.select("own_plant", "own_municipality", "own_state", "own_region", "own_parameter"))
    assert got == [(1, 1, 1, 2, 1), (2, 2, None, None, 1), (3, None, None, None, None),
                   (None, None, None, None, 1), (None, None, None, None, None)]


def test_verify_tells_unique_contained_and_dense(spark):
    t = bundle(
        spark,
        **geo(3),
        municipality=[(1, 1), (1, 2)],
        plant=[(-1, 1, None, "A"), (5, 1, 3, "B")],
        parameter=[(10**9, "pH", None, None), (None, "x", None, None), (None, "y", None, None)],
        measurement=[(1, 5, 1, 10**9, 1, 1.0, 1, 2025), (2, 6, 1, None, 1, 1.0, 1, 2025)],
    )
    keys = verify(t)
    assert "municipality" not in keys.unique and {"state", "plant", "parameter"} <= keys.unique
    assert "measurement.parameter_id" in keys.contained
    assert "measurement.plant_id" not in keys.contained and "plant.office_id" not in keys.contained
    assert "state_id" in keys.dense and not {"plant_id", "parameter_id"} & keys.dense
    assert Keys.from_json(keys.to_json()) == keys


@pytest.mark.parametrize("qid", ["Q6", "Q7", "Q9", "Q10"])
def test_proofs_drop_weights_existence_joins_and_expand(spark, qid):
    fn, kw = QUERIES[qid]
    plain = fixture_tables(spark, SF001)
    proven = plain.having(keys=verify(plain))
    without, with_ = (plan_of(fn(t, ordered=False, **kw)) for t in (plain, proven))
    assert "Expand" in without and "Expand" not in with_
    assert "bitmap_construct_agg" in with_
    assert with_.count("Join") < without.count("Join") or qid == "Q6"
    assert with_.count("Aggregate") < without.count("Aggregate")
    assert rows(fn(proven, **kw)) == rows(fn(plain, **kw))


@pytest.mark.parametrize("qid", ["Q6", "Q7", "Q8", "Q9", "Q10"])
def test_true_proofs_on_repeated_keys_change_nothing(spark, qid):
    """Only what holds is proven, so copies still count."""
    fn = QUERIES[qid][0]
    kw = {"Q7": dict(min_measurements=10), "Q8": dict(min_records=3), "Q9": dict(min_plants=2),
          "Q10": dict(min_measurements=5)}.get(qid, {})
    plain = bundle(spark, **_data())
    keys = verify(plain)
    assert "plant" not in keys.unique and "region" not in keys.unique
    assert rows(fn(plain.having(keys=keys), **kw)) == rows(fn(plain, **kw))


def test_statistics_decide_joins_without_a_job(spark, gold):
    """On analysed dimensions the chains are planned as broadcasts at once."""
    tracker = spark.sparkContext.statusTracker()
    stored = gold.having(grain=None, enriched=False)
    for fn, kw in (QUERIES["Q7"], QUERIES["Q9"]):
        spark.sparkContext.setJobGroup("planning", "no job expected")
        try:
            plan = plan_of(fn(stored, ordered=False, **kw))
            assert not tracker.getJobIdsForGroup("planning")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        optimized = fn(stored, **kw)._jdf.queryExecution().stringWithStats()
        assert "rowCount=" in optimized


@pytest.mark.parametrize("qid", ["Q6", "Q7", "Q9", "Q10"])
def test_stored_rows_send_neither_blocks_nor_expanded_rows(gold, qid):
    """A block of bits a (task, group, thousand ids) outgrows the rows."""
    fn, kw = QUERIES[qid]
    plan = plan_of(fn(gold, ordered=False, **kw))
    assert "bitmap_construct_agg" not in plan and "Expand" not in plan


def test_buckets_follow_the_rows(spark, gold, tmp_path):
    assert buckets_of(0) == buckets_of(ROWS_A_BUCKET) == 8
    assert buckets_of(100 * ROWS_A_BUCKET) == 100 and buckets_of(100 * ROWS_A_BUCKET + 1) == 101
    before = spark.conf.get("spark.sql.shuffle.partitions")
    write_gold(fixture_tables(spark, SF001), str(tmp_path / "store"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert '"buckets": 8' in spark.read.text(str(tmp_path / "store" / "manifest")).first()[0]


def test_fact_is_dealt_once_by_plant_and_not_by_parameter(spark):
    t = fixture_tables(spark, SF001)
    t = t.having(keys=verify(t))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        plan = plan_of(enrich_measurements(fact_rollup(t.measurement, GRAIN), t, 5))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "SortMergeJoin [plant_id" in plan and "Join [parameter_id" not in plan
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(plant_id" in line]
    # the rollup's shuffle by its whole key, then one a side of the join
    assert len(dealt) == 3 and sum("REPARTITION_BY_NUM" in line for line in dealt) == 2


def test_store_proves_what_the_tables_prove(spark, gold):
    assert gold.keys == verify(fixture_tables(spark, SF001))


def test_store_with_orphans_and_nulls(spark, tmp_path):
    pairs = [(1, 1), (1, 2), (1, 2), (2, 1), (3, 7), (4, 1), (None, 1), (2, None), (5, 2), (5, 2)]
    t = bundle(
        spark,
        **geo(2),
        municipality=[(1, 1), (2, 2), (3, 9)],
        plant=[(1, 1, None, "A"), (2, 2, 5, "B"), (3, 8, None, None), (5, 1, 5, "A")],
        parameter=[(1, "pH", None, None), (2, "Cl", None, None)],
        measurement=[(k, p, 1, q, 1, 1.0, 1, 1997) for k, (p, q) in enumerate(pairs)],
    )
    stored = write_gold(t, str(tmp_path / "store"), buckets=3)
    assert not {"measurement.plant_id", "measurement.parameter_id"} & stored.keys.contained
    for qid in ("Q6", "Q9", "Q10"):
        fn, kw = QUERIES[qid]
        kw = {k: 1 if k.startswith("min_") else v for k, v in kw.items()}
        want = rows(fn(t, **kw))
        assert want and rows(fn(stored, **kw)) == want


def test_wide_ranges_of_ids_are_not_counted_by_bitmaps(spark):
    n = 20_000
    t = bundle(
        spark,
        **geo(2),
        municipality=[(1, 1)],
        plant=[(k * 60, 1, None, "A") for k in range(n)],
        parameter=[(1, "pH", None, None)],
        measurement=[(1, 60, 1, 1, 1, 1.0, 1, 2025)],
    )
    assert n * 60 > MAX_BITS
    keys = verify(t, [])
    assert "plant_id" not in keys.dense and "parameter_id" in keys.dense and not keys.contained
