"""Session helpers: cluster sizing and the shared checkpoint folder rule."""

from __future__ import annotations

import pytest

from hydrostar.session import checkpoint_dir, scale_settings


def test_scale_settings_bounds():
    small = scale_settings(10 << 30, total_cores=64)
    assert int(small["spark.sql.shuffle.partitions"]) >= 128
    big = scale_settings(100 << 40, total_cores=8000)
    # 128 MB of the pre-aggregated fact each, without a cap
    assert int(big["spark.sql.shuffle.partitions"]) == 204_800
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, conf=None):
        self.master = master
        self._conf = _Conf(conf or {})
        self._dir = None

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d


class _Session:
    def __init__(self, ctx):
        self.sparkContext = ctx


def test_cluster_requires_shared_checkpoint_folder():
    with pytest.raises(RuntimeError):
        checkpoint_dir(_Session(_Context("yarn")))


def test_configured_folder_wins():
    ctx = _Context("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert checkpoint_dir(_Session(ctx)) == "hdfs:///shared/ckpt"
    assert ctx.getCheckpointDir() == "hdfs:///shared/ckpt"


def test_local_mode_gets_scratch_folder():
    ctx = _Context("local[4]")
    folder = checkpoint_dir(_Session(ctx))
    assert folder and ctx.getCheckpointDir() == folder
