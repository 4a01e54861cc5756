"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a cluster run wants as well as a local one: adaptive execution
# (partition coalescing, skew-join splitting, broadcast conversion at run
# time), UTC dates, and no web UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet files written by the pipeline keep row-group statistics, so
    # the curated tables stay prunable on company and month.
    "spark.sql.parquet.filterPushdown": "true",
}


# Settings for a large cluster (~100 TB of journal lines, ~1000 executors).
# Input splits of 256 MB keep the task count of a full scan near 400k; a high
# initial shuffle partition count lets AQE coalesce to ~256 MB partitions
# rather than be stuck with too few huge ones; skewed partitions above
# 512 MB and 5x the median are split.  Item tables are written zstd.
CLUSTER_CONF = {
    **DEFAULT_CONF,
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    # Coalesce and rebalance to the advisory size, not to the core count
    # (the default favours parallelism, which on a cluster means many small
    # shuffle partitions and small files).
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "ledgerlens",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("LEDGERLENS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system path and is left
    alone.  Only when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(cur)
    return cur
