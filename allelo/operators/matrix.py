"""Long-table matrix operators: indexing, sparse layouts, validation, Gram/cosine.

The long table ``(subject, variant, allele)`` holds only non-zero cells.  Tall
(per-subject) and wide (per-variant) vectors are grouped from it in *blocks*
of at most ``block`` entries, so a single subject (or variant) never turns
into one unbounded row; ``size`` carries the full vector length.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelo.functions.hashing import SPACE, mixed
from allelo.operators.indexing import subject_dictionary, variant_dictionary

DEFAULT_BLOCK = 4096
# subject dictionaries up to this many rows (ids of a few dozen bytes) are broadcast
SUBJECT_BROADCAST_ROWS = 5_000_000


def join_subjects(long: DataFrame, subjects: DataFrame) -> DataFrame:
    """Attach ``subject_index``; the cohort-sized dictionary is broadcast below a checked row bound.

    Broadcasting keeps a subject that carries a large share of all cells from
    turning into one hot shuffle partition; above the bound the join falls back
    to a shuffle join that AQE's skew handling splits.
    """
    n = subjects.count()          # the dictionary is a checkpoint: a cheap count
    side = F.broadcast(subjects) if n <= SUBJECT_BROADCAST_ROWS else subjects
    return long.join(side, "subject_id")


def dedupe_cells(long: DataFrame, row: str = "subject_id", col: str = "variant_key",
                 value: str = "allele") -> DataFrame:
    """A2: resolve duplicate (subject, variant) cells deterministically with ``max``."""
    return long.groupBy(row, col).agg(F.max(value).alias(value))


def index_long(long: DataFrame, subjects: DataFrame | None = None,
               variants: DataFrame | None = None) -> DataFrame:
    """Attach dense ``subject_index`` and ``variant_index`` to a long table.

    The subject dictionary is cohort-sized; the variant dictionary is as large
    as the variant set, so that side is a regular shuffle join (AQE turns it
    into a broadcast only when its runtime size is below the threshold).
    """
    subjects = subjects if subjects is not None else subject_dictionary(long)
    variants = variants if variants is not None else variant_dictionary(long)
    return join_subjects(long, subjects).join(variants, "variant_key")


def matrix_dim(long_idx: DataFrame) -> DataFrame:
    """A4: ``max(variant_index) + 1`` and the subject count."""
    return long_idx.agg((F.max("variant_index") + 1).cast("bigint").alias("n_variants"),
                        (F.max("subject_index") + 1).cast("bigint").alias("n_subjects"))


def to_sparse_blocks(long_idx: DataFrame, row_col: str, index_col: str, size: int | F.Column,
                     value_col: str = "allele", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Group COO cells into sorted sparse vectors, one row per (row, block).

    Output: ``row_col, block, size, indices ARRAY<BIGINT>, values ARRAY<DOUBLE>``.
    ``array_sort`` of ``(index, value)`` structs sorts by index.
    """
    g = (long_idx.groupBy(row_col, (F.col(index_col) / F.lit(block)).cast("bigint").alias("block"))
         .agg(F.array_sort(F.collect_list(F.struct(F.col(index_col).cast("bigint").alias("i"),
                                                   F.col(value_col).cast("double").alias("v")))).alias("e")))
    return g.select(row_col, "block", F.lit(size).cast("bigint").alias("size") if not isinstance(size, F.Column)
                    else size.cast("bigint").alias("size"),
                    F.transform("e", lambda x: x["i"]).alias("indices"),
                    F.transform("e", lambda x: x["v"]).alias("values"))


def from_sparse_blocks(sparse: DataFrame, row_col: str, index_col: str,
                       value_col: str = "allele") -> DataFrame:
    """P24 (inverse): sparse vector rows back to COO cells."""
    return (sparse.select(row_col, F.arrays_zip("indices", "values").alias("z"))
            .select(row_col, F.explode("z").alias("c"))
            .select(row_col, F.col("c.indices").alias(index_col), F.col("c.values").alias(value_col)))


def validate_sparse(sparse: DataFrame, row_col: str) -> DataFrame:
    """Per-row checks (size > 0, equal lengths, 0 <= index < size, values >= 0).

    Returns one row per vector with the min/max index and value and a list of
    violated rules; executors never throw, callers filter ``ok = false``.
    """
    checks = F.array_compact(F.array(
        F.when(F.col("size") <= 0, F.lit("size")),
        F.when(F.size("indices") != F.size("values"), F.lit("length")),
        F.when(F.array_min("indices") < 0, F.lit("index_low")),
        F.when(F.array_max("indices") >= F.col("size"), F.lit("index_high")),
        F.when(F.array_min("values") < 0, F.lit("negative"))))
    return sparse.select(row_col, "block", "size",
                         F.size("indices").alias("nnz"),
                         F.array_min("indices").alias("min_index"), F.array_max("indices").alias("max_index"),
                         F.array_min("values").alias("min_value"), F.array_max("values").alias("max_value"),
                         checks.alias("violations"), (F.size(checks) == 0).alias("ok"))


def burden(long: DataFrame, subject_col: str = "subject_id", value: str = "allele") -> DataFrame:
    """D3: total allele count and carried-variant count per individual."""
    return long.groupBy(subject_col).agg(F.sum(value).alias("burden"),
                                         F.count(F.lit(1)).alias("n_variants"))


# ---------------------------------------------------------------------------
# Gram matrix (A8) and column cosine similarity
# ---------------------------------------------------------------------------

CHUNK = 1024          # variants multiplied at once
EMIT_ROWS = 128       # accumulator rows of one output batch
PRODUCTS = 2_000_000  # products of single cells added at once
DENSE_STEPS = 128     # multiply-adds of a dense product in the time of one product of single cells


def _products(tile: int):
    """mapInArrow body: cells sorted by (ti, tj, variant) stream into one dense accumulator a tile pair.

    Variants with many carriers in both tiles are rows of two dense blocks that are multiplied; the
    products of the others' cells are added one by one, so work follows the products that exist.
    Memory is one ``tile x tile`` accumulator, two ``CHUNK x tile`` blocks, ``PRODUCTS`` products and
    those of a cell, one input batch and the cells of one variant, however many cells the partition has.
    """
    def emit(pair, acc):
        acc = np.triu(acc) if pair[0] == pair[1] else acc
        held = np.flatnonzero(acc.any(axis=1))
        for at in range(0, len(held), EMIT_ROWS):
            r = held[at: at + EMIT_ROWS]
            block = acc[r]
            row, column = np.nonzero(block)
            if 2 * len(row) < block.size:
                offsets = pa.array(np.searchsorted(row, np.arange(len(r) + 1)).astype(np.int32))
                columns = pa.ListArray.from_arrays(offsets, pa.array(column.astype(np.int32)))
                entries = block[row, column]
            else:  # all columns
                offsets = pa.array(np.arange(len(r) + 1, dtype=np.int32) * tile)
                columns, entries = pa.nulls(len(r), pa.list_(pa.int32())), block.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), pair[0], dtype=np.int32)), pa.array(np.full(len(r), pair[1], dtype=np.int32)),
                 pa.array(r.astype(np.int32)), columns, pa.ListArray.from_arrays(offsets, pa.array(entries))],
                names=["ti", "tj", "r", "cs", "g"])

    def add_blocks(acc, number, subject, allele, sides):
        rows = int(number.max()) + 1
        for start in range(0, rows, CHUNK):
            blocks = []
            for at in sides:
                here = at[slice(*np.searchsorted(number[at], [start, start + CHUNK]))]
                block = np.zeros((min(CHUNK, rows - start), tile))
                block[number[here] - start, subject[here] % tile] = allele[here]
                blocks.append(block)
            acc += blocks[0].T @ blocks[1]

    def add_single(acc, column, subject, allele, sides):
        left, right = sides
        first = np.r_[0, np.cumsum(np.bincount(column[right], minlength=int(column[-1]) + 1))]
        begin, n = first[column[left]], np.diff(first)[column[left]]
        ends = np.cumsum(n)
        row, value, other, times = subject[left] % tile * tile, allele[left], subject[right] % tile, allele[right]
        a = 0
        while a < len(left):
            done = int(ends[a] - n[a])
            b = max(a + 1, int(np.searchsorted(ends, done + PRODUCTS, side="right")))
            meets = np.repeat(begin[a:b] - (ends[a:b] - n[a:b] - done), n[a:b]) + np.arange(int(ends[b - 1]) - done)
            np.add.at(acc.reshape(-1), np.repeat(row[a:b], n[a:b]) + other[meets], np.repeat(value[a:b], n[a:b]) * times[meets])
            a = b

    def add(acc, pair, subject, variant, allele):
        column = np.cumsum(np.r_[False, variant[1:] != variant[:-1]])
        sides = [np.flatnonzero(subject // tile == t) for t in pair]
        left, right = (np.bincount(column[at], minlength=int(column[-1]) + 1) for at in sides)
        many = left * right > tile * tile // DENSE_STEPS
        number = np.where(many, np.cumsum(many) - 1, -1)[column]
        if many.any():
            add_blocks(acc, number, subject, allele, [at[number[at] >= 0] for at in sides])
        if not many.all():
            add_single(acc, column, subject, allele, [at[number[at] < 0] for at in sides])

    def run(batches):
        pair, acc, rest = None, np.zeros((tile, tile)), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                columns = [c.to_numpy() for c in batch.columns]
                columns = columns if rest is None else [np.concatenate(c) for c in zip(rest, columns, strict=True)]
                if not len(columns[0]):
                    continue
                new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]]))
                cut = int(new[-1]) + 1 if len(new) else 0  # the last variant may go on
                rest, columns = [c[cut:] for c in columns], [c[:cut] for c in columns]
            else:
                columns, rest = rest, None
            if columns is None or not len(columns[0]):
                continue
            ti, tj, variant, subject, allele = columns
            starts = np.flatnonzero(np.r_[True, (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])])
            for a, b in zip(starts, [*starts[1:], len(ti)], strict=True):
                if pair != (int(ti[a]), int(tj[a])):
                    if pair is not None:
                        yield from emit(pair, acc)
                        acc[:] = 0.0
                    pair = int(ti[a]), int(tj[a])
                add(acc, pair, subject[a:b], variant[a:b], allele[a:b])
        if pair is not None:
            yield from emit(pair, acc)

    return run


def gram(long_idx: DataFrame, n_subjects: int, tile: int = 2048, partitions: int | None = None) -> DataFrame:
    """``G[i, j] = sum_v a_iv * a_jv`` over subjects, upper triangle, non-zero entries.

    Block matrix product: subjects are cut into tiles; each cell is copied to the tile pairs
    in which its variant has cells, dealt by (tile pair, variant slab), sorted, and streamed
    into the pair's dense accumulator.  Accumulator rows come out with their non-zero entries
    (or whole); those of several slabs are shuffled and added up.  There are just enough slabs
    for every partition to have work.  No per-variant list of subject pairs is ever
    materialised as rows.
    """
    spark = long_idx.sparkSession
    n_tiles = max(1, -(-int(n_subjects) // tile))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slabs = max(1, -(-parts // (n_tiles * (n_tiles + 1) // 2)))
    t = (F.col("subject_index") / F.lit(tile)).cast("int")
    met = F.collect_set("t").over(Window.partitionBy("variant_index")) if n_tiles > 1 else F.array("t")
    cells = long_idx.select("subject_index", "variant_index", F.col("allele").cast("double").alias("allele"), t.alias("t"))
    cells = cells.withColumn("met", met).withColumn("o", F.explode("met"))
    cells = cells.select(F.least("t", "o").alias("ti"), F.greatest("t", "o").alias("tj"), "variant_index", "subject_index",
                         "allele", F.pmod(F.xxhash64("variant_index"), F.lit(slabs)).alias("slab"))
    dealt = cells.repartition(parts, "ti", "tj", "slab").sortWithinPartitions("ti", "tj", "variant_index").drop("slab")
    rows = dealt.mapInArrow(_products(tile), "ti int, tj int, r int, cs array<int>, g array<double>")
    if slabs > 1:
        rows = rows.repartition("ti", "tj", "r")
    every = F.sequence(F.lit(0), F.lit(tile - 1))
    cells = rows.select("ti", "tj", "r", F.explode(F.arrays_zip(F.coalesce("cs", every).alias("c"), F.col("g"))).alias("e"))
    cells = cells.select("ti", "tj", "r", "e.c", "e.g")
    if slabs > 1:
        cells = cells.groupBy("ti", "tj", "r", "c").agg(F.sum("g").alias("g"))
    return (cells.where(F.col("g") != 0).select((F.col("ti") * tile + F.col("r")).cast("bigint").alias("i"),
                                               (F.col("tj") * tile + F.col("c")).cast("bigint").alias("j"), "g").where("i <= j"))


def tile_for(n_subjects: int, cap: int = 2048) -> int:
    """Tile edge: two tiles for small cohorts (exercises the tiling), at most ``cap``."""
    return int(min(cap, max(64, -(-int(n_subjects) // 2))))


def squares(long_idx: DataFrame) -> DataFrame:
    """``(subject_index, d)``: squared length of every subject's column."""
    return long_idx.groupBy("subject_index").agg(F.sum(F.col("allele") * F.col("allele")).alias("d"))


def cosine_similarity(long_idx: DataFrame, n_subjects: int, tile: int | None = None) -> DataFrame:
    """``(i, j, cosine)`` of all pairs with a common variant, ``i <= j``; lengths come from the cells."""
    g = gram(long_idx, n_subjects, tile or tile_for(n_subjects))
    d = squares(long_idx)
    return (g.join(d.select(F.col("subject_index").alias("i"), F.col("d").alias("di")), "i")
            .join(d.select(F.col("subject_index").alias("j"), F.col("d").alias("dj")), "j")
            .select("i", "j", (F.col("g") / F.sqrt(F.col("di") * F.col("dj"))).alias("cosine")))


def sampling_scale(n_subjects: int, threshold: float) -> float:
    """Square root of the oversampling factor ``10 ln(n) / threshold`` of the sampled similarities."""
    return math.sqrt(10.0 * math.log(max(n_subjects, 2)) / threshold)


def sampled_cosine(long_idx: DataFrame, n_subjects: int, threshold: float, seed: int = 0,
                   tile: int | None = None) -> DataFrame:
    """D1, sampled: ``(i, j, cosine)`` estimates for ``i < j`` by sampling cells by their column's length.

    With ``s`` from ``sampling_scale``, a cell of a column of length ``l`` stays with
    probability ``min(1, s / l)`` and is divided by ``min(s, l)``; either way the ratio of the
    two is ``1 / l``, so products of what stays estimate cosines without bias.  Long columns,
    whose pairs cost most, are thinned most.  Similarities above ``threshold`` are estimated
    with small relative error; callers leave out those below it.  The draw is a seeded hash of
    (variant, subject), so every pair of cells is drawn independently and SQL can repeat it.
    """
    s = F.lit(sampling_scale(n_subjects, threshold))
    length = squares(long_idx).select("subject_index", F.sqrt("d").alias("l"))
    side = F.broadcast(length) if n_subjects <= SUBJECT_BROADCAST_ROWS else length
    chance = F.least(F.lit(1.0), s / F.col("l"))
    kept = long_idx.join(side, "subject_index").where(
        mixed(seed, F.col("variant_index"), F.col("subject_index")) < chance * SPACE)
    scaled = kept.select("subject_index", "variant_index", (F.col("allele") / F.least(s, F.col("l"))).alias("allele"))
    return (gram(scaled, n_subjects, tile or tile_for(n_subjects)).where("i < j")
            .select("i", "j", F.col("g").alias("cosine")))
