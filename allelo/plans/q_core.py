"""Registered queries: long-table core, indexing, matrices, wide k-means."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelo import fixtures
from allelo.operators import kmeans as km
from allelo.operators import metrics
from allelo.plans.common import KMEANS_TOL, indexed, kmeans_sql, sql_ari, subject_index, with_ctes
from allelo.plans.registry import register, report

FLAGSHIP_K = 5


def _kmeans(spark, sf_dir):
    """Wide k-means of F8 (k=5), run until no centre moves by more than the tolerance."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    return subjects, km.fit(x, subjects, FLAGSHIP_K, tol=KMEANS_TOL)


@register("kmeans_wide", with_ctes(kmeans_sql("planted", FLAGSHIP_K), True) + """
select subject_id, cast(cl as bigint) cluster, round(dist, 6) distance, rounds from a join subj using (si), ended""")
def q_kmeans_wide(spark, sf_dir):
    """M3 + M4: wide k-means (k=5) on F8 to convergence; final assignment per subject and the rounds it took."""
    subjects, res = _kmeans(spark, sf_dir)
    out = res.assignment.join(subjects, "subject_index").select("subject_id", "cluster", "distance",
                                                                F.lit(res.iterations).alias("rounds"))
    return report(out)


@register("kmeans_ari", with_ctes(kmeans_sql("planted", FLAGSHIP_K) + [fixtures.F2_SQL], True) + "," +
          sql_ari("select p.super_pop a, cast(a.cl as bigint) b, count(*) n from a "
                  "join subj using (si) join panel p on p.sample = subj.subject_id group by 1, 2"))
def q_kmeans_ari(spark, sf_dir):
    """Flagship: long table -> wide k-means to convergence -> join panel -> ARI vs super-population."""
    subjects, res = _kmeans(spark, sf_dir)
    panel = fixtures.panel(spark, sf_dir)
    labelled = (res.assignment.join(subjects, "subject_index")
                .join(panel, F.col("subject_id") == F.col("sample")))
    return report(metrics.adjusted_rand_index(labelled, "super_pop", "cluster"))


# ---------------------------------------------------------------------------
# Long-table core: indices, cutoffs, sparse layouts, Gram / cosine
# ---------------------------------------------------------------------------

from allelo.operators import matrix as mx  # noqa: E402
_tile = mx.tile_for
from allelo.plans.common import sql_indexed  # noqa: E402
from allelo.session import scratch_path  # noqa: E402
from allelo.sources import vcf  # noqa: E402

RARE_CUTOFF = 20
BLOCK = 512  # small block so the sf0.01 check exercises several blocks per vector


@register("variant_index", with_ctes(sql_indexed()) +
          "select variant_key, cast(vi as bigint) variant_index from var")
def q_variant_index(spark, sf_dir):
    """Dense 0-based variant index in key order (distributed prefix sum)."""
    _, _, variants, _ = indexed(spark, sf_dir)
    return report(variants.select("variant_key", "variant_index"))


@register("subject_dict", with_ctes(sql_indexed()) +
          "select subject_id, cast(si as bigint) subject_index from subj")
def q_subject_dict(spark, sf_dir):
    """Subject dictionary ``(subject_id, subject_index)``."""
    return report(subject_index(spark, sf_dir))


@register("rare_filter", with_ctes([fixtures.F1_SQL]) + f"""
select subject_id, variant_key, allele from flat
where variant_key in (select variant_key from flat group by variant_key having count(*) > {RARE_CUTOFF})""")
def q_rare_filter(spark, sf_dir):
    """Keep cells of variants carried by more than 20 subjects (strict)."""
    long = fixtures.flat(spark, sf_dir)
    return report(vcf.rare_filter(long, RARE_CUTOFF, ["variant_key"]))


@register("variant_count", with_ctes([fixtures.F1_SQL]) + f"""
select count(*) n_variants from (select variant_key from flat group by variant_key
                                  having count(*) > {RARE_CUTOFF}) t""")
def q_variant_count(spark, sf_dir):
    """Number of variants surviving the cutoff."""
    long = fixtures.flat(spark, sf_dir)
    kept = long.groupBy("variant_key").count().where(F.col("count") > RARE_CUTOFF)
    return report(kept.agg(F.count(F.lit(1)).alias("n_variants")))


@register("matrix_dim", with_ctes(sql_indexed()) +
          "select max(vi) + 1 n_variants, max(si) + 1 n_subjects from x")
def q_matrix_dim(spark, sf_dir):
    """A4: matrix dimensions from the indexed long table."""
    _, _, _, x = indexed(spark, sf_dir)
    return report(mx.matrix_dim(x))


def _sparse_sql(row: str, idx: str, key: str) -> str:
    return f"""select {key}, cast(floor({idx} / {BLOCK}) as bigint) block, max(sz.size) size, count(*) nnz,
       string_agg(cast({idx} as varchar), ',' order by {idx}) indices,
       string_agg(cast(cast(allele as bigint) as varchar), ',' order by {idx}) "values"
from x join {row} using ({row[0]}i) cross join (select count(*) size from {'var' if row == 'subj' else 'subj'}) sz
group by {key}, floor({idx} / {BLOCK})"""


def _render_sparse(df, key):
    return df.select(key, "block", "size", F.size("indices").cast("bigint").alias("nnz"),
                     F.array_join("indices", ",").alias("indices"),
                     F.array_join(F.transform("values", lambda v: v.cast("bigint")), ",").alias("values"))


@register("subject_sparse", with_ctes(sql_indexed()) + _sparse_sql("subj", "vi", "subject_id"))
def q_subject_sparse(spark, sf_dir):
    """Per-subject sparse vectors over variant index, cut into blocks of 512 entries."""
    _, subjects, variants, x = indexed(spark, sf_dir)
    n_var = variants.count()
    sp = mx.to_sparse_blocks(x, "subject_id", "variant_index", n_var, block=BLOCK)
    return report(_render_sparse(sp, "subject_id"))


@register("locus_sparse", with_ctes(sql_indexed()) + _sparse_sql("var", "si", "variant_key"))
def q_locus_sparse(spark, sf_dir):
    """Per-variant sparse vectors over subject index (wide layout)."""
    _, subjects, variants, x = indexed(spark, sf_dir)
    n_sub = subjects.count()
    sp = mx.to_sparse_blocks(x, "variant_key", "subject_index", n_sub, block=BLOCK)
    return report(_render_sparse(sp, "variant_key"))


@register("subject_sparse_dedup", """
with cells AS (select concat('S', cast(l_suppkey as varchar)) subject_id, cast(l_partkey as bigint) variant_key,
                      cast(cast(l_quantity as int) % 3 as double) allele from lineitem),
d AS (select subject_id, variant_key, max(allele) allele from cells group by subject_id, variant_key)
select subject_id, variant_key // 512 block, count(*) nnz, cast(sum(allele) as bigint) total,
       string_agg(cast(variant_key as varchar), ',' order by variant_key) keys
from d where allele <> 0 group by subject_id, variant_key // 512""")
def q_subject_sparse_dedup(spark, sf_dir):
    """Duplicate (subject, variant) cells resolved by max, zeros dropped, grouped per (subject, block)."""
    from allelo.tables import load
    li = load(spark, sf_dir, "lineitem")
    cells = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject_id"),
                      F.col("l_partkey").cast("bigint").alias("variant_key"),
                      (F.col("l_quantity").cast("int") % 3).cast("double").alias("allele"))
    d = mx.dedupe_cells(cells).where(F.col("allele") != 0)
    g = d.groupBy("subject_id", (F.col("variant_key") / 512).cast("bigint").alias("block")).agg(
        F.count(F.lit(1)).alias("nnz"), F.sum("allele").cast("bigint").alias("total"),
                                    F.array_join(F.array_sort(F.collect_list("variant_key")), ",").alias("keys"))
    return report(g)


@register("coo_roundtrip", with_ctes(sql_indexed()) + "select si subject_index, vi variant_index, allele from x")
def q_coo_roundtrip(spark, sf_dir):
    """COO -> blocked sparse vectors -> COO."""
    _, subjects, variants, x = indexed(spark, sf_dir)
    sp = mx.to_sparse_blocks(x, "subject_index", "variant_index", variants.count(), block=BLOCK)
    return report(mx.from_sparse_blocks(sp, "subject_index", "variant_index"))


@register("validate_sparse", with_ctes(sql_indexed()) + f"""
select subject_id, cast(floor(vi / {BLOCK}) as bigint) block, count(*) nnz, min(vi) min_index, max(vi) max_index,
       min(allele) min_value, max(allele) max_value, cast(1 as bigint) ok
from x join subj using (si) group by subject_id, floor(vi / {BLOCK})""")
def q_validate_sparse(spark, sf_dir):
    """Sparse-vector validation report (size, lengths, index range, non-negative values)."""
    _, subjects, variants, x = indexed(spark, sf_dir)
    sp = mx.to_sparse_blocks(x, "subject_id", "variant_index", variants.count(), block=BLOCK)
    v = mx.validate_sparse(sp, "subject_id")
    return report(v.select("subject_id", "block", "nnz", "min_index", "max_index", "min_value", "max_value", "ok"))


@register("burden", with_ctes([fixtures.F1_SQL]) +
          "select subject_id, sum(allele) burden, count(*) n_variants from flat group by subject_id")
def q_burden(spark, sf_dir):
    """D3: allele burden per individual."""
    return report(mx.burden(fixtures.flat(spark, sf_dir)))


@register("gram", with_ctes(sql_indexed()) + """
select a.si i, b.si j, sum(a.allele * b.allele) g from x a join x b on a.vi = b.vi and a.si <= b.si
group by a.si, b.si""")
def q_gram(spark, sf_dir):
    """Gram matrix over subjects (upper triangle) by tiled dense block products."""
    _, subjects, variants, x = indexed(spark, sf_dir, dense_variants=False)
    return report(mx.gram(x, subjects.count(), tile=_tile(subjects.count())))


@register("cosine_exact", with_ctes(sql_indexed()) + """,
g AS (select a.si i, b.si j, sum(a.allele * b.allele) g from x a join x b on a.vi = b.vi and a.si <= b.si
      group by a.si, b.si),
d AS (select i k, g d from g where i = j)
select g.i, g.j, round(g.g / sqrt(di.d * dj.d), 6) cosine from g join d di on di.k = g.i join d dj on dj.k = g.j""")
def q_cosine_exact(spark, sf_dir):
    """Exact cosine similarity between subject columns."""
    _, subjects, variants, x = indexed(spark, sf_dir, dense_variants=False)
    return report(mx.cosine_similarity(x, subjects.count()))


@register("locus_key", with_ctes([fixtures.F1_SQL]) + """
select distinct variant_key, concat(cast(variant_key % 22 + 1 as varchar), ':', cast(variant_key * 100 as varchar)) locus
from flat""")
def q_locus_key(spark, sf_dir):
    """``chr:pos`` key of each variant (F3 coordinates)."""
    from allelo.functions.genotype import locus_key
    v = fixtures.flat(spark, sf_dir).select("variant_key").distinct()
    return report(v.select("variant_key", locus_key(F.col("variant_key") % 22 + 1,
                                                    F.col("variant_key") * 100).alias("locus")))


def _vcf_roundtrip(spark, sf_dir, keep_zero=False, where=None):
    long, subjects, variants, x = indexed(spark, sf_dir, dense_variants=False)
    path = scratch_path(spark, "vcf")
    paths = vcf.write_vcf(x.select("subject_index", "variant_key", "allele"), subjects, subjects.count(), path,
                          long.agg(F.approx_count_distinct("variant_key")).first()[0])
    return vcf.read_vcf(spark, ",".join(paths), keep_zero=keep_zero, where=where)


@register("vcf_lines", with_ctes([fixtures.F1_SQL]) + "select subject_id, variant_key, allele from flat")
def q_vcf_lines(spark, sf_dir):
    """F1 written as VCF text (two files) and parsed back."""
    data = _vcf_roundtrip(spark, sf_dir)
    cells = data.cells
    return report(cells.select("subject_id", (F.col("pos") / 100).cast("bigint").alias("variant_key"), "allele"))


@register("vcf_samples", with_ctes(sql_indexed()) + "select si sample_pos, subject_id from subj")
def q_vcf_samples(spark, sf_dir):
    """Sample names and positions read from the #CHROM header."""
    return report(_vcf_roundtrip(spark, sf_dir).samples)


@register("dosage", with_ctes(sql_indexed()) + """,
calls AS (select case when allele = 2 then '1|1' when vi >= 0 and variant_key % 2 = 0 then '0/1:27' else '0|1' end gt,
                 allele from x join var using (vi)),
tot AS (select (select count(*) from subj) * (select count(*) from var) - (select count(*) from x) zeros)
select gt, allele dosage, count(*) n from calls group by gt, allele
union all select '0|0', 0.0, zeros from tot""")
def q_dosage(spark, sf_dir):
    """Dosage of every genotype string in the VCF text, counted by distinct call."""
    data = _vcf_roundtrip(spark, sf_dir, keep_zero=True)
    return report(data.runs.groupBy("gt").agg(F.first("allele").alias("dosage"), F.sum("n").alias("n")))


@register("dosage_sqrt", with_ctes([fixtures.F1_SQL]) + """
select subject_id, round(sum(sqrt(allele)), 6) sqrt_dosage, count(*) n_phased from flat
where allele = 2 or variant_key % 2 = 1 group by subject_id""")
def q_dosage_sqrt(spark, sf_dir):
    """Legacy square-root dosage, phased calls only, summed per subject."""
    from allelo.functions.genotype import dosage_sqrt
    data = _vcf_roundtrip(spark, sf_dir, keep_zero=True)
    s = data.cells.select("subject_id", dosage_sqrt("gt").alias("d")).where(F.col("d").isNotNull() & (F.col("d") > 0))
    return report(s.groupBy("subject_id").agg(F.sum("d").alias("sqrt_dosage"), F.count(F.lit(1)).alias("n_phased")))


@register("locus_range", with_ctes([fixtures.F1_SQL]) + """
select subject_id, variant_key, allele from flat
where variant_key % 22 + 1 = 7 and variant_key * 100 between 20000 and 120000""")
def q_locus_range(spark, sf_dir):
    """VCF cells in a contig / position window (predicate applied before the genotypes are looked at)."""
    data = _vcf_roundtrip(spark, sf_dir, where=(F.col("contig") == "7") & F.col("pos").between(20000, 120000))
    return report(data.cells.select("subject_id", (F.col("pos") / 100).cast("bigint").alias("variant_key"), "allele"))


@register("kmeans_assign", with_ctes(kmeans_sql("planted", FLAGSHIP_K, rounds=False)) +
          "select subject_id, cast(cl as bigint) cluster, round(dist, 6) distance from a join subj using (si)")
def q_kmeans_assign(spark, sf_dir):
    """M4: assignment to the initial centres (samples 0..k-1) without any update round."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    xp = km.prepare(x)
    n = subjects.count()
    a = km.assign(xp, km.initial_centres(xp, FLAGSHIP_K), subjects.select("subject_index"), FLAGSHIP_K, n)
    return report(a.join(subjects, "subject_index").select("subject_id", "cluster", "distance"))


@register("cluster_sizes", with_ctes(kmeans_sql("planted", FLAGSHIP_K), True) +
          "select cast(cl as bigint) cluster, count(*) n from a group by cl")
def q_cluster_sizes(spark, sf_dir):
    """A10: members per cluster after wide k-means."""
    subjects, res = _kmeans(spark, sf_dir)
    return report(res.assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))


@register("wssse", with_ctes(kmeans_sql("planted", FLAGSHIP_K, rounds=False)) + """
select round(sum(dist), 4) wssse, count(*) n from a""")
def q_wssse(spark, sf_dir):
    """M2: within-cluster sum of squared distances for the initial-centre assignment."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    xp = km.prepare(x)
    n = subjects.count()
    c = km.initial_centres(xp, FLAGSHIP_K)
    a = km.assign(xp, c, subjects.select("subject_index"), FLAGSHIP_K, n)
    w = metrics.wssse(xp, a.select("subject_index", "cluster"), km.centres_to_long(c))
    return report(w.select(F.round("wssse", 4).alias("wssse"), "n"))


@register("locus_range_parquet", with_ctes([fixtures.F1_SQL]) + """
select subject_id, variant_key, allele from flat where variant_key between 200 and 1200""")
def q_locus_range_parquet(spark, sf_dir):
    """Position-window filter on the flat Parquet table, pushed into the scan.

    The table is written sorted by key within files, so row-group statistics
    let the reader skip everything outside the window (``PushedFilters``).
    """
    from allelo.sources import tables_io as tio
    path = tio.write_parquet(fixtures.flat(spark, sf_dir).repartitionByRange(8, "variant_key"),
                             scratch_path(spark, "flat"), cluster_by="variant_key")
    return report(spark.read.parquet(path).where(F.col("variant_key").between(200, 1200)))


@register("vcf_variant_index", with_ctes([fixtures.F1_SQL]) + """select cast(variant_key % 22 + 1 as varchar) contig,
  variant_key * 100 pos, row_number() over (order by variant_key % 22 + 1, variant_key * 100) - 1 variant_index
from (select distinct variant_key from flat) v""")
def q_vcf_variant_index(spark, sf_dir):
    """Variant index of the parsed VCF in genomic order (numeric contigs, then position)."""
    data = _vcf_roundtrip(spark, sf_dir)
    d = vcf.variant_dictionary(data.cells)
    return report(d.select("contig", "pos", "variant_index"))
