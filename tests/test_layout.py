"""The same rows laid out in many row groups (so scans and partial
aggregates run in many tasks) must give the same results as the
one-row-group test files."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest

from hydrostar.plans import catalog
from tests.conftest import SF01

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def split_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("split") / "sf0.01"
    d.mkdir()
    for t in TABLES:
        table = pq.read_table(f"{SF01}/{t}.parquet")
        pq.write_table(table, os.path.join(d, f"{t}.parquet"), row_group_size=2_000)
    assert pq.ParquetFile(os.path.join(d, "lineitem.parquet")).metadata.num_row_groups >= 10
    return str(d)


def test_many_row_groups_same_results(spark, split_dir):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        for key, fn in catalog.queries().items():
            got = [tuple(r) for r in fn(spark, split_dir).collect()]
            want = [tuple(r) for r in fn(spark, SF01).collect()]
            assert got == want, key
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
