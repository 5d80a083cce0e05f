"""Annotate variants with genes lying within a distance window (range join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def genes_near(variants: DataFrame, genes: DataFrame, window: int = 100_000) -> DataFrame:
    """Pairs (variant, gene) on the same contig with distance <= ``window``.

    ``variants(variant_key, contig, pos)``, ``genes(gene, contig, start, end)``.
    Range join as an equi-join on (contig, bin): each gene is copied to the
    ``window``-sized bins its padded span touches (a handful), each variant
    falls in exactly one bin, and the exact distance is checked after the join.
    Distance is 0 inside the gene, else the gap to the nearer end.
    """
    b = F.lit(window)
    g = genes.select("gene", "contig", "start", "end",
                     F.explode(F.sequence(F.floor((F.col("start") - b) / b), F.floor((F.col("end") + b) / b)))
                     .alias("bin"))
    v = variants.select("variant_key", "contig", "pos", F.floor(F.col("pos") / b).alias("bin"))
    dist = F.when(F.col("pos") < F.col("start"), F.col("start") - F.col("pos")) \
        .when(F.col("pos") > F.col("end"), F.col("pos") - F.col("end")).otherwise(F.lit(0))
    return v.join(g, ["contig", "bin"]).select("variant_key", "gene", dist.alias("distance")) \
        .where(F.col("distance") <= window)


def nearest_gene(pairs: DataFrame) -> DataFrame:
    """Per variant: nearest gene (ties -> smallest name) and the number of genes in the window."""
    return pairs.groupBy("variant_key").agg(
        F.min(F.struct("distance", "gene")).alias("b"), F.count(F.lit(1)).alias("n_genes")) \
        .select("variant_key", F.col("b.gene").alias("gene"), F.col("b.distance").alias("distance"), "n_genes")
