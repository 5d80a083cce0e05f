"""Chi-square variant selection on the long table (M17) and its ranking statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000


def chi2_scores(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Pearson chi-square of (dosage value x label) per variant.

    ``cells(sample_index, variant_index, allele)`` non-zero, ``labels(sample_index,
    label)``.  Uses ``chi2 = n * (sum O^2 / (R_a * C_l) - 1)`` over the cells of
    observed values only; the zero-dosage row is derived as label totals minus
    non-zero counts, so no dense matrix is built.  Output
    ``variant_index, statistic, dof``.
    """
    n = labels.count()
    col_tot = labels.groupBy("label").agg(F.count(F.lit(1)).alias("C"))
    classes = [(r["label"], r["C"]) for r in col_tot.collect()]   # one row per class
    known = labels.select("sample_index", "label")
    known = F.broadcast(known) if n <= BROADCAST_ROWS else known
    # one count column a class: one aggregate by (variant, value), one by variant
    o = (cells.join(known, "sample_index").groupBy("variant_index", "allele")
         .agg(F.count(F.lit(1)).alias("R"), *[F.count(F.when(F.col("label") == lab, 1)).alias(f"o{i}")
                                              for i, (lab, _) in enumerate(classes)]))
    q_value = sum((F.col(f"o{i}").cast("double") * F.col(f"o{i}") / (F.col("R").cast("double") * F.lit(float(c)))
                   for i, (_, c) in enumerate(classes)), F.lit(0.0))
    s = o.groupBy("variant_index").agg(
        F.sum(q_value).alias("q_nz"), F.sum("R").alias("r_nz"), F.count(F.lit(1)).alias("v_nz"),
        *[F.sum(f"o{i}").alias(f"nz{i}") for i in range(len(classes))])
    r0 = F.lit(n) - F.col("r_nz")
    q_zero = sum((F.pow(F.lit(float(c)) - F.col(f"nz{i}"), 2) / (r0.cast("double") * F.lit(float(c)))
                  for i, (_, c) in enumerate(classes)), F.lit(0.0))
    q = F.col("q_nz") + F.when(r0 > 0, q_zero).otherwise(F.lit(0.0))
    n_values = F.col("v_nz") + F.when(r0 > 0, 1).otherwise(0)
    return s.select("variant_index", (F.lit(float(n)) * (q - 1.0)).alias("statistic"),
                    ((n_values - 1) * (len(classes) - 1)).cast("bigint").alias("dof"))


def select_top(scores: DataFrame, n: int) -> DataFrame:
    """Top ``n`` variants by statistic (ties -> smallest index): a distributed top-k."""
    return scores.orderBy(F.round("statistic", 9).desc(), F.col("variant_index")).limit(n)
