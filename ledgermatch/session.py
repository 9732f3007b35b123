"""SparkSession helpers shared by tests, bench and the entry module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on. AQE re-plans joins at runtime (broadcast of
# small sides whose size is measured, skewed partition splitting, partition
# coalescing); the session time zone is pinned so dates never shift.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text parsing is CPU-bound: do not merge small shuffle partitions below
    # 256 KB (the 1 MB default would leave cores idle on small, heavy stages).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgermatch", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster, leave ``master`` unset so that spark-submit decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str | None:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``,
    as it stands there; None where it is unset."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's folder for cutting lineage; Spark makes a new one below
    the shared root for each session. Where no root is configured, local
    runs and tests get a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = shared_root(spark)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="ledgermatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()
