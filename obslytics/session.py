"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on.  They are read by Catalyst /
# AQE at plan time, so they are safe to apply to an existing session too.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # RocksDB keeps streaming state off the JVM heap (needed for list state)
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "obslytics", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE and the UI switched off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SQL_DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    # remove checkpoint files once their DataFrame is garbage collected
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_sql_defaults(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> SparkSession:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def configure_for_scale(spark: SparkSession, input_bytes: int, split_bytes: int = 256 << 20,
                        shuffle_target_bytes: int = 128 << 20) -> dict:
    """Size splits and shuffles for an input of ``input_bytes``.

    Input splits of 256 MB keep the task count of a 100 TB scan near 400k.
    The initial shuffle partition count is the input size over 128 MB, so every shuffle block stays far below executor memory; AQE then
    coalesces small shuffles toward the advisory size and splits skewed ones.
    Returns the settings applied.
    """
    shuffle = max(8, -(-input_bytes // shuffle_target_bytes))
    conf = {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_target_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * shuffle_target_bytes),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        return spark.conf.get(key)
    except Exception:  # noqa: BLE001 - unset key
        return None


def default_parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster; from the session config where the
    SparkContext is not exposed (Spark Connect)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return int(_conf(spark, "spark.default.parallelism") or _conf(spark, "spark.sql.shuffle.partitions") or 8)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; that setting always
    wins.  Only a local-mode session without it (tests, laptops) gets a fresh
    folder under the system temp dir.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        configured = _conf(spark, "spark.checkpoint.dir")
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return configured
    configured = sc.getConf().get("spark.checkpoint.dir", None) or _conf(spark, "spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="obslytics-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, any executor can reread it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
