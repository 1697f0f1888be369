"""Session construction and the shared scratch folder.

Materialized intermediate tables are written below the folder the cluster
names in ``spark.checkpoint.dir`` (a shared file system on a real cluster).
Only when that setting is absent -- local runs and tests -- do we create one.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parquet is the working format; keep nested pruning on (default in 4.x).
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
}


# Profile for the target scale: ~100 TB of input on ~1000 executors.
# Largest shuffle = classified file rows (line-item scale): ~600e9 rows x ~40 B
# of shuffled columns ~ 24 TB; at ~256 MB per reducer that is ~100k reducers.
# AQE coalesces from this upper bound and splits skewed partitions.
CLUSTER_CONF = {
    **DEFAULT_CONF,
    "spark.sql.shuffle.partitions": "100000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Scan splits: 512 MB of Parquet per task.
    "spark.sql.files.maxPartitionBytes": "512m",
    # Static and runtime broadcast limits (the PaC list / catalog sides).
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.compression.codec": "zstd",
    # Losing executors: keep shuffle output when an executor goes away and
    # migrate blocks off decommissioning executors.
    "spark.shuffle.service.enabled": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.task.maxFailures": "8",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "histofold", extra: dict | None = None,
              profile: str = "local") -> SparkSession:
    """Session with the package defaults; ``profile="cluster"`` applies ``CLUSTER_CONF``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (CLUSTER_CONF if profile == "cluster" else DEFAULT_CONF).items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: ``spark.checkpoint.dir`` if set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    if not d:
        try:  # classic sessions only; a Connect session has no SparkContext
            sc = spark.sparkContext
            d = sc.getCheckpointDir()
        except Exception:
            sc = None
    if not d:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # A local run without a named folder.
        d = tempfile.mkdtemp(prefix="histofold-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")
