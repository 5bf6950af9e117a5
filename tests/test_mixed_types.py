"""Files of one table that disagree on a column's type."""

from __future__ import annotations

import pytest

from hydrostar.plans import base
from hydrostar.sources.schema import SCHEMAS
from hydrostar.sources.tables import load_tables, same_types
from tests.frames import bundle
from tests.test_copies import _data


@pytest.fixture()
def folder(spark, tmp_path):
    """``value`` as DOUBLE, FLOAT, text and INT; a key as text; a file without
    a column."""
    data = _data()
    t = bundle(spark, **data)
    path = str(tmp_path)
    for name in SCHEMAS:
        if name != "measurement":
            getattr(t, name).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    fact = t.measurement
    kinds = ["double", "float", "string", "int", "double", "string"]
    for k, kind in enumerate(kinds):
        part = fact.where(f"coalesce(measurement_id, 0) % {len(kinds)} = {k}")
        part = part.withColumn("value", part.value.cast(kind))
        if k == 4:
            part = part.withColumn("plant_id", part.plant_id.cast("string"))
        if k == 5:
            part = part.withColumn("month", part.month.cast("int"))
        part.coalesce(1).write.mode("append").parquet(f"{path}/measurement.parquet")
    bad = spark.createDataFrame([(7, 1, 1, 1, 1, "n/a", 1, 2025)],
                                "measurement_id long, plant_id long, point_id long, parameter_id long, "
                                "band_id long, value string, month long, year long")
    bad.coalesce(1).write.mode("append").parquet(f"{path}/measurement.parquet")
    return path, t, bad


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_mixed_files_load_with_the_declared_types(spark, folder):
    path, t, bad = folder
    got = load_tables(spark, path, mixed_types=True)
    assert [(f.name, f.dataType) for f in got.measurement.schema] == [
        (f.name, f.dataType) for f in SCHEMAS["measurement"]
    ]
    want = t.measurement.unionByName(bad.selectExpr(*[
        f"try_cast({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in SCHEMAS["measurement"]
    ]))
    assert sorted(rows(got.measurement), key=str) == sorted(rows(want), key=str)
    whole = t.having()
    whole.measurement = want
    for fn, kw in ((base.geo_activity, {}), (base.band_distribution, {"min_records": 3})):
        assert rows(fn(got, **kw)) == rows(fn(whole, **kw))


def test_files_are_grouped_by_type(spark, folder):
    path = f"{folder[0]}/measurement.parquet"
    groups = same_types(spark, path)
    assert sorted(len(files) for files, _ in groups) == [1, 1, 1, 1, 1, 2]
    assert len({f for files, _ in groups for f in files}) == 7


def test_one_type_is_one_read(spark, folder):
    path = f"{folder[0]}/plant.parquet"
    assert len(same_types(spark, path)) == 1
    plan = load_tables(spark, folder[0], mixed_types=True).plant
    assert "Union" not in plan._jdf.queryExecution().optimizedPlan().toString()
