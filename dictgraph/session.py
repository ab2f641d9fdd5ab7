"""Session defaults for local runs and tests.

On a cluster the caller owns the session; nothing here overrides settings
that are already present.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dictgraph") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # per-hop checkpoints of the graph loops are removed once unreachable
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("DICTGRAPH_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only a local-mode session without one (tests, laptops) gets a fresh
    scratch folder, because a machine-local folder is no use to executors on
    other hosts.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side SparkContext
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        if not str(spark.conf.get("spark.master", "")).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; iterative operators need a shared checkpoint folder")
        configured = tempfile.mkdtemp(prefix="dictgraph-ckpt-", dir=os.environ.get("DICTGRAPH_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared, "
            "reliable checkpoint folder on a cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dictgraph-ckpt-", dir=os.environ.get("DICTGRAPH_SCRATCH", "/tmp")))
    return sc.getCheckpointDir()
