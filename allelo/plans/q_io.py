"""Registered queries: Parquet / CSV / text sinks and sources, exported matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelo import fixtures
from allelo.operators import kmeans as km
from allelo.operators import matrix as mx
_tile = mx.tile_for
from allelo.plans.common import KMEANS_TOL, subject_index, indexed, kmeans_sql, sql_indexed, with_ctes
from allelo.plans.registry import register, report
from allelo.session import scratch_path
from allelo.sources import tables_io as tio

WIDE_SQL = with_ctes([fixtures.F6_SQL])


def _wide_roundtrip(spark, sf_dir, numeric):
    long = fixtures.wide_long(spark, sf_dir)
    if numeric:
        long = long.withColumn("label", F.col("label").cast("double") / 4.0)
    paths = tio.write_wide_csv(long, scratch_path(spark, "wide"), numeric=numeric)
    return tio.read_wide_csv(spark, ",".join(paths), numeric=numeric)


@register("wide_csv_binary", WIDE_SQL + """select id, cast(label as bigint) label, cast(feature as bigint) feature_index,
  round(cast(cast(x as float) as double), 6) x from wide""")
def q_wide_csv_binary(spark, sf_dir):
    """Wide labelled CSV (``"",aBeta,...`` header) written and read back long."""
    features, cells = _wide_roundtrip(spark, sf_dir, numeric=False)
    return report(cells.select("id", "label", "feature_index", "x"))


@register("wide_csv_numeric", WIDE_SQL + """select id, round(label / 4.0, 6) label, cast(feature as bigint) feature_index,
  round(cast(cast(x as float) as double), 6) x from wide""")
def q_wide_csv_numeric(spark, sf_dir):
    """Numeric-response wide CSV (header one field shorter than rows) read back long."""
    features, cells = _wide_roundtrip(spark, sf_dir, numeric=True)
    return report(cells.select("id", "label", "feature_index", "x"))


@register("feature_by_name", WIDE_SQL + """select distinct cast(feature as bigint) feature_index,
  'f' || cast(feature as varchar) name from wide where 'f' || cast(feature as varchar) = 'f17'""")
def q_feature_by_name(spark, sf_dir):
    """Feature index by header name (``f17``) from the wide CSV dictionary."""
    features, _ = _wide_roundtrip(spark, sf_dir, numeric=False)
    return report(tio.feature_by_name(features, "f17").withColumn("name", F.lit("f17")))


@register("flat_roundtrip", with_ctes([fixtures.F1_SQL]) + "select subject_id, variant_key, allele from flat")
def q_flat_roundtrip(spark, sf_dir):
    """Flat-variant Parquet sink and source (clustered by variant for row-group skipping)."""
    path = tio.write_parquet(fixtures.flat(spark, sf_dir).repartition(8, "variant_key"),
                             scratch_path(spark, "flat"), cluster_by="variant_key")
    return report(spark.read.parquet(path))


def _sparse_parquet(spark, sf_dir, by_subject):
    long, subjects, variants, x = indexed(spark, sf_dir)
    if by_subject:
        sp = mx.to_sparse_blocks(x, "subject_id", "variant_index", variants.count(), block=512)
    else:
        sp = mx.to_sparse_blocks(x, "variant_key", "subject_index", subjects.count(), block=512)
    path = tio.write_parquet(sp, scratch_path(spark, "sparse"))
    back = spark.read.parquet(path)
    key = "subject_id" if by_subject else "variant_key"
    return back, key


@register("subject_sparse_parquet", with_ctes(sql_indexed()) + """select subject_id, count(*) nnz,
  cast(sum(vi) as bigint) index_sum, sum(allele) value_sum from x join subj using (si) group by subject_id""")
def q_subject_sparse_parquet(spark, sf_dir):
    """Subject-sparse vectors written to Parquet (array columns) and read back."""
    back, key = _sparse_parquet(spark, sf_dir, True)
    cells = mx.from_sparse_blocks(back, key, "variant_index")
    return report(cells.groupBy(key).agg(F.count(F.lit(1)).alias("nnz"), F.sum("variant_index").alias("index_sum"),
                                         F.sum("allele").alias("value_sum")))


@register("locus_sparse_parquet", with_ctes(sql_indexed()) + """select variant_key, count(*) nnz,
  cast(sum(si) as bigint) index_sum, sum(allele) value_sum from x join var using (vi) group by variant_key""")
def q_locus_sparse_parquet(spark, sf_dir):
    """Locus-sparse vectors written to Parquet and read back."""
    back, key = _sparse_parquet(spark, sf_dir, False)
    cells = mx.from_sparse_blocks(back, key, "subject_index")
    return report(cells.groupBy(key).agg(F.count(F.lit(1)).alias("nnz"), F.sum("subject_index").alias("index_sum"),
                                         F.sum("allele").alias("value_sum")))


@register("subject_dict_io", with_ctes(sql_indexed()) + "select subject_id, si subject_index from subj")
def q_subject_dict_io(spark, sf_dir):
    """Subject dictionary side file (own sub-path, CSV) written and read back."""
    subjects = subject_index(spark, sf_dir)
    path = tio.write_csv(subjects.select("subject_id", "subject_index"), scratch_path(spark, "subjects"))
    return report(spark.read.schema("subject_id STRING, subject_index BIGINT").csv(path))


@register("assignments_io", with_ctes(kmeans_sql("planted", 5, rounds=False)) +
          "select subject_id subject, cast(cl as bigint) cluster from a join subj using (si)")
def q_assignments_io(spark, sf_dir):
    """Cluster assignment CSV sink / source."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    xp = km.prepare(x)
    a = km.assign(xp, km.initial_centres(xp, 5), subjects.select("subject_index"), 5, subjects.count())
    out = a.join(subjects, "subject_index").select(F.col("subject_id").alias("subject"), "cluster")
    path = tio.write_csv(out, scratch_path(spark, "assign"))
    return report(tio.read_assignments(spark, path))


def _exported(spark, sf_dir):
    """F8 written as a labelled wide matrix; the folders of the label line and of the rows."""
    from allelo.plans.q_ml import _inputs

    cells, labels, _, variants = _inputs(spark, sf_dir)
    lab, body = tio.wide_export_lines(cells, labels, labels.count(), variants.count())
    path = scratch_path(spark, "export")
    lab.write.text(f"{path}/labels")
    body.select(F.concat_ws(":", F.col("variant_index").cast("string"), "value").alias("value")).write.option(
        "compression", "gzip").text(f"{path}/rows")
    return f"{path}/labels", f"{path}/rows"


@register("wide_export", with_ctes(sql_indexed("planted")) + """select vi variant_index, count(*) nnz,
  cast(sum(allele) as bigint) total from x group by vi""")
def q_wide_export(spark, sf_dir):
    """Labelled wide-matrix export (label line + one int line per variant); the rows re-read and summarised."""
    _, rows = _exported(spark, sf_dir)
    # zeros after the first value go before the text is split: no other whole number starts with 0
    back = spark.read.text(rows).select(F.split(F.replace("value", F.lit(",0")), ":").alias("p"))
    vals = back.select(F.col("p")[0].cast("bigint").alias("variant_index"),
                       F.split(F.col("p")[1], ",").alias("v"))
    summ = vals.select("variant_index", F.aggregate(F.transform("v", lambda s: s.cast("int")), F.lit(0),
                                                    lambda a, b: a + b).alias("total"),
                       F.size(F.filter("v", lambda s: s != "0")).alias("nnz"))
    return report(summ)


@register("wide_export_labels", with_ctes(sql_indexed("planted") + [fixtures.F2_SQL]) + """select si sample_index, label
  from subj join panel on panel.sample = subj.subject_id join (select super_pop, row_number() over (order by super_pop) - 1 label
  from (select distinct super_pop from panel) t) l using (super_pop)""")
def q_wide_export_labels(spark, sf_dir):
    """The label line of the export, read back: the label of every sample in order."""
    labels, _ = _exported(spark, sf_dir)
    back = spark.read.text(labels).select(F.posexplode(F.split("value", ",")).alias("sample_index", "label"))
    return report(back.select("sample_index", F.col("label").cast("bigint").alias("label")))


@register("gram_export", with_ctes(sql_indexed()) + """, g AS (select a.si i, b.si j, sum(a.allele * b.allele) g
  from x a join x b on a.vi = b.vi group by a.si, b.si)
select i row_index, cast(sum(g) as bigint) row_sum, count(*) nonzero from g group by i""")
def q_gram_export(spark, sf_dir):
    """Gram matrix rows as dense CSV lines, re-read and summarised per row."""
    long, subjects, variants, x = indexed(spark, sf_dir, dense_variants=False)
    n = subjects.count()
    lines = tio.gram_lines(mx.gram(x, n, tile=_tile(n)), n)
    path = scratch_path(spark, "gram")
    lines.select(F.concat_ws(":", F.col("i").cast("string"), "value").alias("value")).write.text(path)
    back = spark.read.text(path).select(F.split("value", ":").alias("p"))
    v = back.select(F.col("p")[0].cast("bigint").alias("row_index"),
                    F.transform(F.split(F.col("p")[1], ","), lambda s: s.cast("bigint")).alias("v"))
    return report(v.select("row_index", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("row_sum"),
                           F.size(F.filter("v", lambda s: s != 0)).alias("nonzero")))


@register("cluster_members", with_ctes(kmeans_sql("planted", 5), True) + """select cast(cl as bigint) cluster,
  'Cluster Id : ' || cast(cl as varchar) || '-------> Samples : ' || string_agg(subject_id, ',' order by si) line
  from a join subj using (si) group by cl""")
def q_cluster_members(spark, sf_dir):
    """Cluster membership listing, one line a cluster."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    res = km.fit(x, subjects, 5, tol=KMEANS_TOL)
    a = res.assignment.join(subjects, "subject_index")
    lines = tio.cluster_member_lines(a)
    return report(lines.select("cluster", "line"))


@register("json_export", with_ctes([fixtures.F1_SQL]) + """select subject_id, variant_key // 512 block,
  count(*) n_variants, sum(allele) total from flat group by subject_id, variant_key // 512""")
def q_json_export(spark, sf_dir):
    """Per-subject genotype records (blocks of 512 variant keys) written as JSON lines and read back."""
    f = fixtures.flat(spark, sf_dir)
    recs = f.groupBy("subject_id", (F.col("variant_key") / 512).cast("bigint").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("variant_key", "allele"))).alias("calls"))
    path = scratch_path(spark, "json")
    tio.json_lines(recs).write.text(path)
    back = spark.read.schema("subject_id STRING, block BIGINT, "
                             "calls ARRAY<STRUCT<variant_key: BIGINT, allele: DOUBLE>>").json(path)
    return report(back.select("subject_id", "block", F.size("calls").alias("n_variants"),
                              F.aggregate("calls", F.lit(0.0), lambda a, c: a + c["allele"]).alias("total")))


@register("sif_export", with_ctes(kmeans_sql("planted", 5), True) + """select subject_id source, 'in_cluster' relation,
  'C' || cast(cl as varchar) target from a join subj using (si)""")
def q_sif_export(spark, sf_dir):
    """Predictions as a SIF edge list (source, relation, target), written as text and parsed back."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    res = km.fit(x, subjects, 5, tol=KMEANS_TOL)
    a = res.assignment.join(subjects, "subject_index").select(
        "subject_id", F.lit("in_cluster").alias("rel"), F.concat(F.lit("C"), F.col("cluster").cast("string")).alias("c"))
    path = scratch_path(spark, "sif")
    tio.sif_lines(a, "subject_id", "rel", "c").write.text(path)
    back = spark.read.option("sep", "\t").schema("source STRING, relation STRING, target STRING").csv(path)
    return report(back)
