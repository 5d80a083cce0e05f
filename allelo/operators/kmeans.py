"""Wide k-means (M3-M5) on the long genotype table, and tall k-means (M1).

Layout: ``X(subject_index, variant_index, allele)`` non-zero cells,
hash-partitioned by ``variant_index`` and checkpointed once.  Centres are
stored *wide*: one row per variant with an array of ``k`` coordinates, grouped
by ``variant_index`` too, so

* the distance step ``X join C on variant_index`` needs no exchange of X,
  and reduces to ``n_subjects x k`` partial sums (map-side combined);
* the update step ``X join assignment`` (cohort-sized, broadcast) followed by
  ``groupBy(variant_index)`` needs no exchange either.

One round is one job over X: the centres of an assignment and the products of
every sample with them.  What a round needs besides follows from these products,
as a centre is the mean of its members: its squared norm is the mean product of
its members with it, and its product with the centre before is the mean of the
members' products with that one.  So the centres are never kept between rounds,
and the centre shift, which ends the rounds, costs one aggregate over the samples.

Only ``k``-sized vectors (cluster sizes, norms, shifts) reach the driver.  Ties in
the nearest centre resolve to the smallest cluster id after rounding distances to
9 decimals.  An empty cluster gets an all-zero centre, as in the original.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelo.session import checkpoint_partitioned, pinned

# cohort-sized tables up to this many rows are broadcast explicitly
BROADCAST_ROWS = 2_000_000


@dataclass
class KMeansResult:
    centres: DataFrame      # variant_index, c ARRAY<DOUBLE>  (k coordinates)
    assignment: DataFrame   # subject_index, cluster, distance
    iterations: int         # rounds until no centre moved by more than the tolerance, or the most allowed
    shift: float            # the last round's largest centre shift
    x: DataFrame | None = None  # the partitioned cells it was fitted on


def prepare(long_idx: DataFrame, partitions: int | None = None) -> DataFrame:
    """Partition the cells by variant and pin them with a reliable checkpoint."""
    spark = long_idx.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = long_idx.select("subject_index", "variant_index", F.col("allele").cast("double").alias("allele"))
    return checkpoint_partitioned(cells, parts, "variant_index")


def _small(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def initial_centres(x: DataFrame, k: int) -> DataFrame:
    """Centre j starts as sample j (subject indices 0..k-1)."""
    sums = [F.sum(F.when(F.col("subject_index") == j, F.col("allele")).otherwise(0.0)) for j in range(k)]
    return x.where(F.col("subject_index") < k).groupBy("variant_index").agg(F.array(*sums).alias("c"))


def centres_from_long(centres_long: DataFrame, k: int) -> DataFrame:
    """Warm start: ``(cluster, variant_index, c)`` rows -> wide centre arrays."""
    sums = [F.sum(F.when(F.col("cluster") == j, F.col("c")).otherwise(0.0)) for j in range(k)]
    return centres_long.groupBy("variant_index").agg(F.array(*sums).alias("c"))


def centres_to_long(centres: DataFrame) -> DataFrame:
    """Wide centre arrays -> ``(cluster, variant_index, c)`` rows without zeros."""
    return (centres.select("variant_index", F.posexplode("c").alias("cluster", "c"))
            .where(F.col("c") != 0)
            .select(F.col("cluster").cast("bigint").alias("cluster"), "variant_index", "c"))


def squared_norms(x: DataFrame) -> DataFrame:
    """``(subject_index, x2)``: constant over all rounds, so ``fit`` computes it once."""
    return x.groupBy("subject_index").agg(F.sum(F.col("allele") * F.col("allele")).alias("x2"))


def products(x: DataFrame, centres: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """``samples`` with ``dot``, the product of each with every centre (0 for all-zero samples)."""
    dot = (x.join(centres, "variant_index").groupBy("subject_index")
           .agg(F.array(*[F.sum(F.col("allele") * F.col("c")[j]) for j in range(k)]).alias("dot")))
    zeros = F.array(*[F.lit(0.0)] * k)
    return samples.join(dot, "subject_index", "left").withColumn("dot", F.coalesce("dot", zeros))


def nearest(norms: list[float]) -> Column:
    """``struct(d, cluster)`` of the nearest centre, from ``x2``, ``dot`` and the centres' squared norms."""
    return F.array_min(F.array(*[
        F.struct(F.round(F.col("x2") - 2.0 * F.col("dot")[j] + F.lit(c2), 9).alias("d"),
                 F.lit(j).cast("bigint").alias("cluster")) for j, c2 in enumerate(norms)]))


def centre_norms(centres: DataFrame, k: int) -> list[float]:
    row = centres.agg(*[F.sum(F.col("c")[j] * F.col("c")[j]).alias(f"c{j}") for j in range(k)]).first()
    return [float(v or 0.0) for v in row]


def assign(x: DataFrame, centres: DataFrame, subjects: DataFrame, k: int, n_subjects: int,
           x2: DataFrame | None = None) -> DataFrame:
    """Nearest centre per subject.

    ``subjects(subject_index)`` lists every sample (all-zero ones included).
    """
    x2 = squared_norms(x) if x2 is None else x2
    samples = subjects.join(x2, "subject_index", "left").withColumn("x2", F.coalesce("x2", F.lit(0.0)))
    best = nearest(centre_norms(centres, k))
    return products(x, centres, samples, k).select("subject_index", best["cluster"].alias("cluster"),
                                                   best["d"].alias("distance"))


def update(x: DataFrame, assignment: DataFrame, k: int, n_subjects: int) -> tuple[DataFrame, list[int]]:
    """New centres = mean of member vectors (zeros included via the cluster size)."""
    sizes = [n for n, _ in _members(assignment.withColumn("dot", F.array(*[F.lit(0.0)] * k)), k)]
    return _means(x, assignment, sizes, n_subjects), sizes


def _means(x: DataFrame, assignment: DataFrame, sizes: list[int], n_subjects: int) -> DataFrame:
    members = x.join(_small(assignment.select("subject_index", "cluster"), n_subjects), "subject_index")
    coords = [(F.sum(F.when(F.col("cluster") == j, F.col("allele")).otherwise(0.0)) / F.lit(float(n)))
              if n > 0 else F.lit(0.0) for j, n in enumerate(sizes)]
    return members.groupBy("variant_index").agg(F.array(*coords).alias("c"))


def _members(rows: DataFrame, k: int) -> list[tuple[int, float]]:
    """Per cluster: its size and the mean product of its members with centre ``j`` of ``dot``."""
    in_j = [F.col("cluster") == j for j in range(k)]
    row = rows.agg(*[F.count_if(c).alias(f"n{j}") for j, c in enumerate(in_j)],
                   *[F.sum(F.when(c, F.col("dot")[j])).alias(f"s{j}") for j, c in enumerate(in_j)]).first()
    return [(row[j], float(row[k + j]) / row[j] if row[j] else 0.0) for j in range(k)]


def fit(long_idx: DataFrame, subjects: DataFrame, k: int, iterations: int | None = None,
        init_centres: DataFrame | None = None, tol: float = 1e-3) -> KMeansResult:
    """M3 / M5: wide k-means until no centre moves by more than ``tol``, or for ``iterations`` rounds at most.

    ``subjects(subject_index)`` must hold every sample; ``init_centres`` is an
    optional wide centre table ``(variant_index, c)`` to continue from.  A
    tolerance below 0 asks for exactly ``iterations`` rounds.
    """
    if iterations is None and tol < 0:
        raise ValueError("a number of rounds or a tolerance must end the rounds")
    x = prepare(long_idx)
    n = subjects.count()
    samples = subjects.select("subject_index").join(squared_norms(x), "subject_index", "left") \
        .withColumn("x2", F.coalesce("x2", F.lit(0.0)))
    centres = pinned(init_centres if init_centres is not None else initial_centres(x, k), "centres")
    rows = pinned(products(x, centres, samples, k), "products")
    norms = centre_norms(centres, k)
    done, moved = 0, float("inf")
    while done != iterations and moved > tol:
        best = nearest(norms)
        assignment = rows.select("subject_index", "x2", best["cluster"].alias("cluster"), "dot")
        mean_old = _members(assignment, k)
        centres = _means(x, assignment, [size for size, _ in mean_old], n)
        rows = pinned(products(x, centres, assignment.drop("dot"), k), "products")
        fresh = [mean for _, mean in _members(rows, k)]
        moved = max(max(new - 2.0 * old + before, 0.0) ** 0.5
                    for new, (_, old), before in zip(fresh, mean_old, norms, strict=True))
        norms, done = fresh, done + 1
    best = nearest(norms)
    assignment = rows.select("subject_index", best["cluster"].alias("cluster"), best["d"].alias("distance"))
    return KMeansResult(centres=centres, assignment=assignment, iterations=done, shift=moved, x=x)
