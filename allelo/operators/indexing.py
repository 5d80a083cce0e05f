"""Dense 0-based indices over ordered keys.

A global ``row_number()`` without ``partitionBy`` runs in one task.  Instead the
keys are range-partitioned and sorted, each row gets
``monotonically_increasing_id()`` (partition id in the high bits, position in
the partition in the low 33 bits), the table is checkpointed to pin those ids,
and a prefix sum over the per-partition counts (one row per partition, so its
size is bounded by the partition count) turns them into dense positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelo.session import checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def dense_index(keys: DataFrame, order_cols: list[str], name: str,
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0..n-1 following ``order_cols`` (keys must be distinct)."""
    spark = keys.sparkSession
    checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (keys.repartitionByRange(n_parts, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint())
    pid = F.shiftright(F.col("_mid"), 33)
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranged.withColumn("_pid", pid)
            .join(F.broadcast(offsets), "_pid")          # one row per partition
            .withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))).cast("bigint"))
            .drop("_pid", "_off", "_mid"))


def subject_dictionary(long: DataFrame, subject_col: str = "subject_id") -> DataFrame:
    """``(subject_id, subject_index)`` in ascending id order."""
    return dense_index(long.select(subject_col).distinct(), [subject_col], "subject_index")


def variant_dictionary(long: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """``(variant key..., variant_index)`` in genomic/key order (stable, unlike file order)."""
    key_cols = key_cols or ["variant_key"]
    return dense_index(long.select(*key_cols).distinct(), key_cols, "variant_index")


def prefix_sum(df: DataFrame, order_col: str, value: Column, name: str,
               partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order_col`` order, without a single-task window.

    Rows are range-partitioned and checkpointed; a window *within* each range
    partition gives the local running sum and a prefix sum over the
    per-partition totals (one row per partition, broadcast) gives the offset.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.withColumn("_v", value.cast("bigint")).repartitionByRange(n_parts, order_col)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    local = ranged.withColumn("_loc", F.sum("_v").over(
        Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("_pid").agg(F.sum("_v").alias("_t"))
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_v", "_pid", "_loc", "_off"))


def running_removed(df: DataFrame, index_col: str, removed: Column, name: str = "shift") -> DataFrame:
    """Running count of removed entries up to and including each index (distributed prefix sum)."""
    return prefix_sum(df, index_col, removed, name)


def label_ordinal(df: DataFrame, label_col: str, name: str = "label_index") -> DataFrame:
    """Distinct labels coded 0..L-1 in sorted order, joined back onto ``df``."""
    return df.join(class_index(df, label_col, name), label_col, "left")


def class_index(df: DataFrame, col: str, name: str) -> DataFrame:
    """Dense 0-based codes of a *bounded* vocabulary (label classes, populations).

    The distinct values of a class column are few, so a single ordered window
    over them is cheaper than the distributed prefix sum of ``dense_index``.
    """
    d = df.select(col).distinct().where(F.col(col).isNotNull())
    return d.select(col, (F.row_number().over(Window.orderBy(col)) - 1).cast("bigint").alias(name))
