"""Every registered query with broadcasting off: the sort-merge plans a
large cluster runs must give the same rows as the broadcast plans."""

from __future__ import annotations

import pytest

from hydrostar.plans import catalog
from tests.conftest import SF001

OFF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(scope="module")
def expected(spark):
    return {k: [tuple(r) for r in fn(spark, SF001).collect()] for k, fn in catalog.queries().items()}


@pytest.fixture()
def no_broadcast(spark):
    saved = {k: spark.conf.get(k, None) for k in OFF}
    for k, v in OFF.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_sort_merge_plans_match(spark, expected, no_broadcast):
    for key, fn in catalog.queries().items():
        df = fn(spark, SF001)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in df.collect()]
        assert got == expected[key], key
        if key.startswith(("Q6", "Q7", "Q9", "Q10")):
            assert "SortMergeJoin" in plan, key
