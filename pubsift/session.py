"""Spark session helpers.

Everything here is plain Spark configuration.  On a cluster the session is
created by the platform; :func:`ensure_checkpoint_dir` only fills in a
checkpoint folder when the cluster did not name one (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on.  AQE re-plans joins at runtime (it turns a
# sort-merge join into a broadcast join only when the measured side is under
# the broadcast threshold, and splits skewed partitions), which is the size
# check we want for every join whose small side grows with the data.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "pubsift", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset.

    On a cluster this folder must be shared storage (HDFS, S3, ...): lineage
    cuts written there survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Local runs and tests only: a fresh folder per session.
        configured = tempfile.mkdtemp(prefix="pubsift-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df):
    """Write an intermediate that several branches of a plan read to Parquet
    under the checkpoint folder and read it back.

    Every consumer then scans the written files instead of re-running the
    upstream plan (tokenising, joins), the lineage is cut (a lost executor
    re-reads files, it does not recompute), and the read is columnar with
    pruning.  The folder is shared storage on a cluster.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"mat-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)
