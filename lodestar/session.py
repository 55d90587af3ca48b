"""Spark session helpers.

Library code never creates its own session; callers pass one in.  These
helpers exist for tests, the bench and the driver entry point.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "lodestar", conf: dict | None = None) -> SparkSession:
    master = master or os.environ.get("LODESTAR_MASTER", "local[8]")
    b = SparkSession.builder
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = (
        b.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: the cluster's ``spark.checkpoint.dir``, or the checkpoint
    folder that the context has been given.  Only a local master without either gets
    a folder of this machine; on a cluster that is an error, as executors would not
    see it."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        d = _LOCAL_DIRS.get(sc.applicationId)
    if not d:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        d = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="lodestar-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
