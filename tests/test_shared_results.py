"""Results kept across sessions: reused, and recomputed when a file changes;
coarse grains from one stored fine grain."""

from __future__ import annotations

import os

import pytest

from hydrostar.plans import base
from hydrostar.plans.pages import page
from hydrostar.plans.reuse import ResultStore, SharedResults, listing
from hydrostar.sources.fixture import fixture_tables
from hydrostar.sources.tables import load_tables
from tests.conftest import SF001
from tests.test_pages import PARAMS


@pytest.fixture()
def folder(spark, tmp_path):
    t = fixture_tables(spark, SF001)
    path = str(tmp_path / "tables")
    for name in ("region", "state", "municipality", "office", "institution", "plant", "point",
                 "parameter", "band", "measurement"):
        getattr(t, name).write.parquet(f"{path}/{name}.parquet")
    return path


def opened(spark, folder, tmp_path):
    """A store and a counter of what it builds."""
    store = SharedResults(spark, str(tmp_path / "kept"), [folder])
    built = []

    def get(tables, qid="Q1"):
        return store.get(qid, lambda: built.append(qid) or base.filtration_share(tables), owner=tables)

    return get, built


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_a_second_session_reuses_and_a_changed_file_recomputes(spark, folder, tmp_path):
    tables = load_tables(spark, folder)
    get, built = opened(spark, folder, tmp_path)
    first = rows(get(tables))
    assert built == ["Q1"] and rows(get(tables)) == first and built == ["Q1"]

    other = spark.newSession()
    get, built = opened(other, folder, tmp_path)
    later = load_tables(other, folder)
    assert rows(get(later)) == first and built == []

    extra = spark.createDataFrame([(10**9, 1, 1, "NEW KIND")], later.plant.schema)
    extra.write.mode("append").parquet(f"{folder}/plant.parquet")
    spark.catalog.refreshByPath(f"{folder}/plant.parquet")
    get, built = opened(other, folder, tmp_path)
    again = rows(get(load_tables(other, folder)))
    assert built == ["Q1"] and ("NEW KIND", 1) in [r[:2] for r in again]


def test_an_unfinished_result_is_not_read(spark, folder, tmp_path):
    get, built = opened(spark, folder, tmp_path)
    tables = load_tables(spark, folder)
    want = rows(get(tables))
    kept = str(tmp_path / "kept")
    (result,) = os.listdir(kept)
    done = os.path.join(kept, result, "done")
    for name in os.listdir(done):
        open(os.path.join(done, name), "w").close()  # a writer that died before its line
    get, built = opened(spark, folder, tmp_path)
    assert rows(get(tables)) == want and built == ["Q1"]


def test_fingerprint_follows_names_sizes_and_times(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("same")
    seen = [listing(spark, [str(tmp_path)])]
    assert listing(spark, [str(tmp_path)]) == seen[0]
    os.utime(tmp_path / "a", (1, 1))
    seen.append(listing(spark, [str(tmp_path)]))
    (tmp_path / "c").write_text("x")
    seen.append(listing(spark, [str(tmp_path)]))
    assert len(set(seen)) == 3


def test_pages_share_one_scan_of_the_fact(spark):
    """Q6, Q7 and Q9 of two pages come from one stored grain."""
    plain, store = fixture_tables(spark, SF001), ResultStore(spark)
    scans = []
    get = store._materialised

    def watched(key, build):
        def run():
            df = build()
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            scans.append((key.split(":")[0], "l_orderkey" in plan))
            return df

        return get(key, run)

    store._materialised = watched
    found = page("institutional", plain, store, PARAMS) | page("quality", plain, store, PARAMS)
    assert dict(scans) == {"grain": True, "Q6": False, "Q7": False, "Q8": False, "Q9": False}
    for rid, fn in (("Q6", base.geo_activity), ("Q7", base.institution_performance), ("Q9", base.state_ranking)):
        assert rows(found[rid]) == rows(fn(fixture_tables(spark, SF001), **PARAMS.get(rid, {})))


def test_filtered_queries_alone_do_not_store_the_grain(spark):
    store = ResultStore(spark)
    page("temporal", fixture_tables(spark, SF001), store, PARAMS)
    assert len(store._results) == 1
