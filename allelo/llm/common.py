"""Helpers shared by the corpus operators: narrowing inputs, Arrow maps, scratch tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelo.session import checkpoint_dir, scratch_path

#: rows of one output Arrow batch; bounds what a task holds besides its input batch
OUT_ROWS = 20_000
FEW_GROUPS = 1000


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: clashing extra columns drop out."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def arrow_map(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, rows_at_once: int | None = None) -> DataFrame:
    """Run ``fn(*columns as lists) -> iterable of row tuples`` on every Arrow batch.

    Output rows are flushed every ``OUT_ROWS`` rows, so memory per task is one
    input batch plus one output batch.  ``rows_at_once`` cuts both for rows with
    long values: batches go to ``fn`` in slices of that many rows.
    """
    spark = df.sparkSession
    struct = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else \
        spark.createDataFrame([], schema).schema
    names, types = struct.names, [_arrow_type(f.dataType) for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        flush = rows_at_once or OUT_ROWS
        for whole in batches:
            step = rows_at_once or max(whole.num_rows, 1)
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                for row in fn(*[c.to_pylist() for c in batch.columns]):
                    rows.append(row)
                    if len(rows) >= flush:
                        yield _batch(rows, names, types)
                        rows = []
        if rows:
            yield _batch(rows, names, types)

    return df.mapInArrow(run, struct)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
              T.FloatType: pa.float32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(),
              T.BinaryType: pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[type(kind)]


def ids_by_number(words: pa.Array, lookup: Callable[[list[str]], list[bytes]]) -> tuple[bytes, list[int]]:
    """Ids of the words of all lists, one after the other, and where each list starts and the last ends, in bytes.

    Arrow numbers the words, ``lookup`` gives the ids (little-endian, 32 bits) of each distinct
    one, and these are gathered by number: repeated words cost no lookups.
    """
    import numpy as np
    import pyarrow.compute as pc

    encoded = pc.list_flatten(words).dictionary_encode()
    number, held = encoded.indices.to_numpy(), lookup(encoded.dictionary.to_pylist())
    sizes = np.array(list(map(len, held)), dtype=np.int64) // 4
    ids, first = np.frombuffer(b"".join(held), dtype="<u4"), np.cumsum(sizes) - sizes
    sizes = sizes[number]
    ends = np.cumsum(sizes)
    raw = ids[np.repeat(first[number] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    offsets = words.offsets.to_numpy()
    return raw, (4 * np.r_[0, ends][offsets - offsets[0]]).tolist()


class Scratch:
    """Parquet tables below ``spark.checkpoint.dir``: the lineage cuts of one operator run.

    A table survives lost executors (the folder is shared), keeps only the
    columns a later step reads, and is dropped as soon as nothing refers to it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        checkpoint_dir(spark)
        self.root = scratch_path(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back; Spark deletes the write's shuffle files when it ends."""
        path = f"{self.root}/{name}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


    def release(self) -> None:
        """Let Spark free the shuffle files of finished steps now, not at the driver's next garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, group: str, key: str, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows of each group, with the smallest seeded hashes of ``key``.

    Groups are counted first and rows beyond a hash threshold, set for somewhat
    more than ``most`` rows, dropped before rows meet to be ranked: what meets is in
    proportion to ``most``, however large a group is.  The thresholds of up to
    ``FEW_GROUPS`` large groups go into the scan; those of more are joined.
    """
    from pyspark.sql import Window

    counts = df.groupBy(group).count().where((F.col("count") > 1.2 * most + 100) & F.col(group).isNotNull()) \
        .select(F.col(group).alias("_g"), ((1.2 * most + 100) / F.col("count")).alias("_limit"))
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    out = df.withColumn("_h", share)
    large = {r["_g"]: r["_limit"] for r in counts.limit(FEW_GROUPS + 1).collect()}
    if len(large) > FEW_GROUPS:
        out = out.join(counts, F.col(group) == F.col("_g"), "left").where(
            F.col("_h") <= F.coalesce("_limit", F.lit(1.0))).drop("_g", "_limit")
    elif large:
        limits = F.create_map(*[F.lit(x) for pair in sorted(large.items()) for x in pair])
        out = out.where(F.col("_h") <= F.coalesce(F.element_at(limits, F.col(group)), F.lit(1.0)))
    first = Window.partitionBy(group).orderBy("_h", key)
    return out.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_h", "_r")
