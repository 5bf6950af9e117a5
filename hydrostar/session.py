"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query in this package relies on.  AQE re-plans joins from
# runtime sizes (sort-merge -> broadcast when a side turns out small), splits
# skewed shuffle partitions and coalesces small ones.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # What the planner's statistics (first) or finished shuffles (second) show
    # to be smaller than this is broadcast; nothing else is.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # Oracle comparison and month()/year() on timestamps must not depend on
    # the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Plans are defined by hundreds of column calls; recording the Python call
    # site of each costs more than planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Join sizes follow column statistics where tables have been analysed.
    "spark.sql.cbo.enabled": "true",
    # Checkpoint files of results nobody references any more are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "hydrostar",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine settings.

    On a cluster, pass ``master=None`` and let spark-submit decide; size
    ``spark.sql.shuffle.partitions`` to the data (AQE coalesces downwards,
    so err on the high side).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(ENGINE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and reused results.

    A cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Only a local-mode session (tests, a laptop) without it gets a scratch
    folder; on a cluster a machine-local folder would not survive the loss
    of an executor, so the setting is required there.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder on shared storage "
            "(e.g. HDFS or an object store) for checkpoints"
        )
    local = tempfile.mkdtemp(prefix="hydrostar-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def scale_settings(
    fact_bytes: int,
    total_cores: int,
    partition_bytes: int = 256 << 20,
    shuffle_fraction: float = 0.25,
) -> dict[str, str]:
    """Settings for a cluster run, sized to the measurement input.

    * scan splits of ``partition_bytes`` (Parquet row groups should be of
      that order when the fact is written);
    * shuffle partitions sized to the largest shuffle, the pre-aggregated
      fact (``shuffle_fraction`` of the input; it is at most the number of
      distinct grain keys per map task), twice the cores at least; AQE
      coalesces small ones at run time;
    * skew handling for sort-merge joins over dimension-sized sides.
    """
    shuffle_bytes = int(fact_bytes * shuffle_fraction)
    parts = max(2 * total_cores, shuffle_bytes // (partition_bytes // 2))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }
