"""Session construction and the few cluster-facing helpers every job shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for this workload:
# * AQE re-plans joins and coalesces small shuffle partitions at run time and
#   splits skewed join partitions.
# * maxPartitionBytes bounds the html bytes one task holds while the regex
#   extraction runs; html is by far the widest column.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # shuffle partitions are sized at run time: start high on a cluster and
    # let AQE coalesce to ~128 MB per reducer
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "pagemill",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
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


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and stage tables.

    Read from ``spark.checkpoint.dir``. Only a local session may do without:
    it gets a private folder. On a cluster each executor would write to a disk
    of its own, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="pagemill-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for one job's output."""
    base = shared_dir(spark)
    return os.path.join(base, f"{name}-{os.urandom(6).hex()}")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows round-robin to ``partitions`` (default: the cluster's cores).

    For small inputs in few scan splits, ahead of row-wise regex work. It
    shuffles whole rows, so readers do it only where the caller asks for it.
    """
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table under the shared folder and read it
    back: cuts the lineage, so a lost executor or a retried later step
    restarts from the table instead of recomputing everything upstream."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
