"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup = threading.Lock()


def build_session(master: str | None = None, app: str = "chartloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and a UTC clock."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; fall back to a new local folder
    only where none is configured (tests, laptops)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF, None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-chartloom-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it back from there,
    so later steps neither recompute it nor see other values after a lost executor.

    Nothing reads the shuffle files behind it any more, so they are removed at once; else they
    would stay on the executors' disks until the driver happens to collect its garbage."""
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    with _cleanup:  # a plan takes the setting over when it is made
        before = conf.get(_CLEANUP_CONF)
        conf.set(_CLEANUP_CONF, "true")
        try:
            written = df.select("*")
        finally:
            conf.set(_CLEANUP_CONF, before)
    return written.checkpoint(eager=True)
