"""Session construction, checkpoint directory and shared scratch paths.

On a cluster, ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/ABFS);
iterative operators cut their lineage with reliable ``checkpoint()`` calls
into it and sinks used inside queries write below it.  A local fallback folder
is only created when the session runs in local mode and nothing is configured
(tests, benchmarks).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_ROOT: str | None = None
#: uncompressed bytes of a compressed text file, which one task writes and reads as a stream; most files of a table
SHARD_BYTES, MOST_SHARDS = 256 << 20, 10_000


def get_spark(cpus: int | str = "*", app: str = "allelo",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session configured the way the tests and the bench expect."""
    n = shuffle_partitions or (8 if cpus == "*" else max(2, int(cpus)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only in local mode."""
    global _LOCAL_ROOT
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for this cluster")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="allelo-ckpt-")
    sc.setCheckpointDir(_LOCAL_ROOT)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_dir(spark)
    return os.path.join(root, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def pinned(df, name: str):
    """``df`` written below the shared checkpoint folder and read back: a plan leaf without history.

    A checkpoint keeps the constraints Catalyst inferred for its plan, and every
    round of an iterative operator adds more until planning them takes longer
    than the work; a written table has none.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_shards(spark: SparkSession, lines: int, line_bytes: int) -> int:
    """How many files long lines are dealt to when they are written compressed."""
    needed = min(-(-lines * line_bytes // SHARD_BYTES), MOST_SHARDS)
    return max(needed, int(spark.conf.get("spark.sql.shuffle.partitions")))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing refers to any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint_partitioned(df, partitions: int, *cols: str):
    """Hash-partition ``df`` by ``cols`` and checkpoint it *keeping* that partitioning.

    Under adaptive execution the checkpointed relation reports an unknown
    partitioning, so every later join/aggregation on ``cols`` would shuffle
    the data again.  Planning this one materialisation non-adaptively lets the
    checkpoint record ``hashpartitioning(cols, partitions)`` and the order;
    iterative operators then join and aggregate on ``cols`` without an exchange
    or a sort of it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.repartition(partitions, *cols).sortWithinPartitions(*cols).checkpoint()
    finally:
        spark.conf.set(key, before)
