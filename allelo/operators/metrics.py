"""Evaluation metrics as aggregations.

Everything is computed from small sufficient statistics (contingency cells,
per-class counts, sums of squares) that Spark aggregates with map-side
combining; no label list is ever collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelo.session import checkpoint_dir


def _pairs(n: Column) -> Column:
    """C(n, 2) as double (no INT overflow at cohort scale)."""
    n = n.cast("double")
    return n * (n - 1.0) / 2.0


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sparse contingency cells ``(a, b, n)`` with row/column margins."""
    ct = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return (ct.withColumn("row_total", F.sum("n").over(Window.partitionBy(a)))
              .withColumn("col_total", F.sum("n").over(Window.partitionBy(b))))


def adjusted_rand_index(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ARI of two labelings; one row ``(n, ari)``, or one for each group of ``by``.

    ``(index - expected) / (mean(sumA, sumB) - expected)`` with
    ``expected = sumA * sumB / C(n, 2)``; all pair counts are doubles.  A
    degenerate input whose denominator is 0 (e.g. both labelings constant)
    is defined as 1.0.
    """
    ct = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    of_a, of_b = Window.partitionBy(*by, a), Window.partitionBy(*by, b)
    ct = (ct.withColumn("_ra", F.row_number().over(of_a.orderBy(b)))
            .withColumn("_rb", F.row_number().over(of_b.orderBy(a)))
            .withColumn("_ma", F.sum("n").over(of_a))
            .withColumn("_mb", F.sum("n").over(of_b)))
    s = ct.groupBy(*by).agg(F.sum("n").alias("n"),
                            F.sum(_pairs(F.col("n"))).alias("idx"),
                            F.sum(F.when(F.col("_ra") == 1, _pairs(F.col("_ma")))).alias("sa"),
                            F.sum(F.when(F.col("_rb") == 1, _pairs(F.col("_mb")))).alias("sb"))
    expected = F.when(F.col("n") > 1, F.col("sa") * F.col("sb") / _pairs(F.greatest("n", F.lit(2)))).otherwise(0.0)
    denom = (F.col("sa") + F.col("sb")) / 2.0 - expected
    ari = F.when(denom == 0, F.lit(1.0)).otherwise((F.col("idx") - expected) / F.nullif(denom, F.lit(0.0)))
    return s.select(*by, F.col("n").cast("bigint").alias("n"), ari.alias("ari"))


def classification_error(df: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Fraction of mismatches; one row ``(n, error)``, or one for each group of ``by``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.avg((F.col(label) != F.col(prediction)).cast("double")).alias("error"))


def gini(df: DataFrame, group_cols: list[str], label: str, weight: str | None = None) -> DataFrame:
    """Gini impurity ``1 - sum (n_l/n)^2`` and majority label (ties -> largest label)."""
    w = F.col(weight) if weight else F.lit(1)
    counts = df.groupBy(*group_cols, label).agg(F.sum(w).alias("_n"))
    tot = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_t", F.sum("_n").over(tot))
    agg = counts.groupBy(*group_cols).agg(
        F.sum("_n").cast("bigint").alias("size"),
        F.max_by(label, F.struct("_n", label)).alias("majority"),
        (1.0 - F.sum(F.pow(F.col("_n") / F.col("_t"), 2))).alias("impurity"))
    return agg


def majority_vote(votes: DataFrame, key_cols: list[str], label: str) -> DataFrame:
    """Most frequent label per key; ties resolve to the largest label."""
    c = votes.groupBy(*key_cols, label).agg(F.count(F.lit(1)).alias("_v"))
    return c.groupBy(*key_cols).agg(F.max_by(label, F.struct("_v", label)).alias("vote"),
                                    F.sum("_v").alias("n_votes"))


def confusion(df: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion cells ``(label, prediction, n)``, for each group of ``by``."""
    return df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(df: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per-class precision / recall / F1 (pairs passed in the correct order), for each group of ``by``."""
    cells = confusion(df, label, prediction, by)
    key = [*by, "cls"]
    actual = cells.groupBy(*by, F.col(label).alias("cls")).agg(F.sum("n").alias("actual"))
    predicted = cells.groupBy(*by, F.col(prediction).alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = cells.where(F.col(label) == F.col(prediction)).select(*by, F.col(label).alias("cls"), F.col("n").alias("tp"))
    j = actual.join(predicted, key, "full").join(tp, key, "left").fillna(0, ["actual", "predicted", "tp"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0)
    return j.select(*key, F.col("tp").cast("bigint").alias("tp"), F.col("actual").cast("bigint").alias("actual"),
                    F.col("predicted").cast("bigint").alias("predicted"), p.alias("precision"), r.alias("recall"),
                    F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MSE, RMSE, MAE and R^2 = 1 - SSE/SST in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
               F.sum((p - y) * (p - y)).alias("sse"), F.sum(F.abs(p - y)).alias("sae"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select(F.col("n").cast("bigint").alias("n"), (F.col("sse") / F.col("n")).alias("mse"),
                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"),
                    (1.0 - F.col("sse") / sst).alias("r2"))


def run_summary(runs: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Mean, sample stddev and standard error of per-run metrics."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metric_cols:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
                 (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_se")]
    return runs.agg(*aggs)


def wssse(long_idx: DataFrame, assignment: DataFrame, centres: DataFrame) -> DataFrame:
    """M2: within-cluster sum of squared errors.

    ``long_idx(subject_index, variant_index, allele)``,
    ``assignment(subject_index, cluster)``, ``centres(cluster, variant_index, c)``
    (long, non-zero only).  Per sample ``|x|^2 - 2 x.c + |c|^2``.
    """
    x2 = long_idx.groupBy("subject_index").agg(F.sum(F.col("allele") * F.col("allele")).alias("x2"))
    c2 = centres.groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("c2"))
    xa = long_idx.join(assignment, "subject_index")
    dot = (xa.join(centres, ["cluster", "variant_index"])
           .groupBy("subject_index").agg(F.sum(F.col("allele") * F.col("c")).alias("xc")))
    per = (assignment.join(x2, "subject_index", "left").join(dot, "subject_index", "left")
           .join(c2, "cluster", "left").fillna(0.0, ["x2", "xc", "c2"]))
    d = F.col("x2") - 2 * F.col("xc") + F.col("c2")
    return per.agg(F.sum(d).alias("wssse"), F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, value_col: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """Average (tie-shared) 1-based rank of ``value_col`` without a single-task window.

    Distinct values with their counts are range-partitioned; a per-partition
    running count plus an offset from the per-partition totals (one row per
    partition) gives ``#smaller + (#equal + 1) / 2``.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(value_col).desc() if descending else F.col(value_col).asc()
    counts = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("_c"))
    ranged = (counts.repartitionByRange(parts, key).sortWithinPartitions(key)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    local = ranged.withColumn("_below", F.coalesce(F.sum("_c").over(
        Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = ranged.groupBy("_pid").agg(F.sum("_c").alias("_t"))
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranks = local.join(F.broadcast(offsets), "_pid").select(
        value_col, (F.col("_off") + F.col("_below") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranks, value_col)


def mann_whitney(ranked: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """Mann-Whitney U of ``group_col`` (boolean) over ``value_col`` with tie-averaged ranks.

    Returns ``n1, n2, u, z`` (normal approximation without tie correction).
    """
    r = average_rank(ranked, value_col, "_r")
    g = F.col(group_col).cast("boolean")
    s = r.agg(F.sum(F.when(g, 1).otherwise(0)).alias("n1"), F.sum(F.when(g, 0).otherwise(1)).alias("n2"),
              F.sum(F.when(g, F.col("_r")).otherwise(0.0)).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    mu = F.col("n1") * F.col("n2") / 2.0
    sigma = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    return s.select(F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"),
                    u.alias("u"), ((u - mu) / sigma).alias("z"))


def rank_biased_overlap(rank_s: DataFrame, rank_t: DataFrame, item: str, depth: int,
                        p: float = 0.9) -> DataFrame:
    """Truncated rank-biased overlap ``(1-p) sum_{k<=d} p^(k-1) |S_k & T_k| / k``.

    Inputs are ``(item, rank)`` tables with 1-based ranks.  An item shared by
    both rankings enters every prefix from ``k = max(rank_s, rank_t)`` on, so
    it contributes ``(1-p) sum_{k=m}^{d} p^(k-1)/k``; those suffix weights come
    from a ``depth``-row table.
    """
    spark = rank_s.sparkSession
    ks = spark.range(1, depth + 1).select(F.col("id").alias("k"))
    term = (1.0 - p) * F.pow(F.lit(p), F.col("k") - 1) / F.col("k")
    weights = ks.select("k", F.sum(term).over(
        Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)).alias("w"))
    both = (rank_s.select(item, F.col("rank").alias("rs")).join(rank_t.select(item, F.col("rank").alias("rt")), item)
            .select(F.greatest("rs", "rt").alias("k")).where(F.col("k") <= depth))
    return both.join(weights, "k").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("rbo"))
