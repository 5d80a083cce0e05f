"""allelo: cohort genotype analytics expressed as Spark DataFrame plans.

The primary data layout is the *long* genotype table
``(subject_id, variant_key, allele)`` with reference (zero) calls dropped.
Tall (per-subject) and wide (per-variant) vector layouts are aggregations of
it, and every algorithm (wide k-means, level-wise decision forests, chi-square
selection, metrics) is a sequence of joins, aggregations and windows over
long tables so Catalyst plans and distributes the work.
"""

from allelo.session import get_spark, checkpoint_dir, scratch_path  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "scratch_path"]
