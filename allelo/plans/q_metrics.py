"""Registered queries: metrics, chi-square selection, rank statistics, sampling, annotation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from allelo import fixtures
from allelo.functions.genotype import encode
from allelo.functions.hashing import below, mixed_sql, text_key_sql
from allelo.operators import annotate, metrics, sampling
from allelo.operators import select as sel
from allelo.plans.common import indexed, sql_ari, sql_indexed, with_ctes
from allelo.plans.registry import register, report
from allelo.tables import load

F7 = with_ctes([fixtures.F7_SQL])


@register("contingency", F7 + """select cast(c1 as bigint) c1, cast(c2 as bigint) c2, count(*) n,
  cast(sum(count(*)) over (partition by c1) as bigint) row_total,
  cast(sum(count(*)) over (partition by c2) as bigint) col_total
from pairs group by c1, c2""")
def q_contingency(spark, sf_dir):
    """Contingency table of two labelings with margins."""
    return report(metrics.contingency(fixtures.pairs(spark, sf_dir), "c1", "c2"))


@register("ari", "WITH " + fixtures.F7_SQL + ",\n" + sql_ari("select c1 a, c2 b, count(*) n from pairs group by 1, 2"))
def q_ari(spark, sf_dir):
    """Adjusted Rand index of two labelings (pair counts in doubles, no overflow)."""
    return report(metrics.adjusted_rand_index(fixtures.pairs(spark, sf_dir), "c1", "c2"))


@register("class_error", F7 + "select count(*) n, round(avg(case when c1 <> c2 then 1.0 else 0.0 end), 6) error "
          "from pairs")
def q_class_error(spark, sf_dir):
    """Classification error (c2 as prediction of c1)."""
    return report(metrics.classification_error(fixtures.pairs(spark, sf_dir), "c1", "c2"))


@register("gini", F7 + """, t AS (select c2, c1, count(*) n, sum(count(*)) over (partition by c2) tot
  from pairs group by c2, c1)
select cast(c2 as bigint) c2, cast(sum(n) as bigint) size, cast(arg_max(c1, n * 10 + c1) as bigint) majority,
  round(1 - sum((n / tot) * (n / tot)), 6) impurity from t group by c2""")
def q_gini(spark, sf_dir):
    """Gini impurity and majority (ties -> largest) of c1 within each c2 group."""
    return report(metrics.gini(fixtures.pairs(spark, sf_dir), ["c2"], "c1"))


@register("confusion", F7 + "select cast(c1 as bigint) label, cast(c2 as bigint) prediction, count(*) n from pairs group by 1, 2")
def q_confusion(spark, sf_dir):
    """Confusion matrix cells (label, prediction)."""
    p = fixtures.pairs(spark, sf_dir).select(F.col("c1").alias("label"), F.col("c2").alias("prediction"))
    return report(metrics.confusion(p, "label", "prediction"))


@register("precision_recall", F7 + """, cls AS (select c1 cls from pairs union select c2 from pairs),
a AS (select c1 cls, count(*) actual from pairs group by c1),
p AS (select c2 cls, count(*) predicted from pairs group by c2),
t AS (select c1 cls, count(*) tp from pairs where c1 = c2 group by c1),
j AS (select cls, coalesce(tp, 0) tp, coalesce(actual, 0) actual, coalesce(predicted, 0) predicted
      from cls left join a using (cls) left join p using (cls) left join t using (cls)),
m AS (select *, case when predicted > 0 then tp / predicted else 0.0 end pr,
             case when actual > 0 then tp / actual else 0.0 end rc from j)
select cast(cls as bigint) cls, tp, actual, predicted, round(pr, 6) "precision", round(rc, 6) recall,
       round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end, 6) f1 from m""")
def q_precision_recall(spark, sf_dir):
    """Per-class precision / recall / F1 with (label, prediction) in the right order."""
    return report(metrics.precision_recall(fixtures.pairs(spark, sf_dir), "c1", "c2"))


REG_SQL = """with p AS (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / 1000.0 pred
  from lineitem group by l_orderkey),
j AS (select o_totalprice / 1000.0 y, pred from orders join p on p.l_orderkey = o_orderkey),
s AS (select count(*) n, sum(y) sy, sum(y * y) syy, sum((pred - y) * (pred - y)) sse, sum(abs(pred - y)) sae from j)
select n, round(sse / n, 4) mse, round(sqrt(sse / n), 4) rmse, round(sae / n, 4) mae,
       round(1 - sse / (syy - sy * sy / n), 6) r2 from s"""


@register("regression_metrics", REG_SQL)
def q_regression_metrics(spark, sf_dir):
    """MSE / RMSE / MAE / R^2 of a predicted order value against the recorded total (in thousands)."""
    li = load(spark, sf_dir, "lineitem")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    p = li.groupBy("l_orderkey").agg(
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))) / 1000.0).alias("pred"))
    j = o.join(p, o.o_orderkey == p.l_orderkey).select((F.col("o_totalprice") / 1000.0).alias("y"), "pred")
    m = metrics.regression_metrics(j, "y", "pred")
    return report(m.select("n", F.round("mse", 4).alias("mse"), F.round("rmse", 4).alias("rmse"),
                           F.round("mae", 4).alias("mae"), "r2"))


FOLD_SQL = F7 + """, f AS (select doc_id % 10 fold, avg(case when c1 <> c2 then 1.0 else 0.0 end) error
  from pairs group by doc_id % 10)"""


def _fold_errors(spark, sf_dir):
    p = fixtures.pairs(spark, sf_dir).withColumn("fold", F.col("doc_id") % 10)
    return p.groupBy("fold").agg(F.avg((F.col("c1") != F.col("c2")).cast("double")).alias("error"))


@register("run_summary", FOLD_SQL + """select count(*) n_runs, round(avg(error), 6) error_mean,
  round(stddev_samp(error), 6) error_std, round(stddev_samp(error) / sqrt(count(error)), 6) error_se from f""")
def q_run_summary(spark, sf_dir):
    """Mean, standard deviation and standard error of per-fold errors."""
    return report(metrics.run_summary(_fold_errors(spark, sf_dir), ["error"]))


@register("cv_mean", FOLD_SQL + "select round(avg(error), 6) cv_error from f")
def q_cv_mean(spark, sf_dir):
    """Cross-validation mean of a per-fold metric, here of two labelings' disagreement."""
    from allelo.operators import validation as val

    pairs = fixtures.pairs(spark, sf_dir).withColumn("part", F.col("doc_id") % 10)
    _, mean = val.evaluate(pairs, lambda df, by: metrics.classification_error(df, "c1", "c2", by), "error")
    return report(mean.select(F.col("mean").alias("cv_error")))


# -------------------------------------------------------------- chi-square

CHI2_TOP = 20
CHI2_SQL = with_ctes(sql_indexed("planted") + [fixtures.F2_SQL, """lab AS (select si, label from subj
  join panel on panel.sample = subj.subject_id join (select super_pop, row_number() over (order by super_pop) - 1 label
  from (select distinct super_pop from panel) t) l using (super_pop))""",
    "ct AS (select label, count(*) c from lab group by label)",
    "nn AS (select count(*) n from lab)",
    "o AS (select x.vi, x.allele, lab.label, count(*) o from x join lab using (si) group by 1, 2, 3)",
    """z AS (select v.vi, cast(0.0 as double) allele, ct.label, ct.c - coalesce(sum(o.o), 0) o
  from (select distinct vi from o) v cross join ct left join o on o.vi = v.vi and o.label = ct.label
  group by v.vi, ct.label, ct.c)""",
    "a AS (select * from o union all select * from z where o > 0)",
    "r AS (select vi, allele, sum(o) r from a group by vi, allele)",
    """chi AS (select a.vi, (select n from nn) * (sum(cast(a.o as double) * a.o / (r.r * ct.c)) - 1) statistic,
  (count(distinct a.allele) - 1) * ((select count(*) from ct) - 1) dof
  from a join r using (vi, allele) join ct using (label) group by a.vi)"""])


def _chi2(spark, sf_dir, dense_variants=True):
    from allelo.operators.indexing import class_index
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=dense_variants)
    p = fixtures.panel(spark, sf_dir)
    lab = class_index(p, "super_pop", "label")
    labels = (subjects.join(p, subjects.subject_id == p["sample"]).join(lab, "super_pop")
              .select(F.col("subject_index").alias("sample_index"), "label"))
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    return sel.chi2_scores(cells, labels), variants


@register("chi2_scores", CHI2_SQL + "select vi variant_index, round(statistic, 6) statistic, cast(dof as bigint) dof "
          "from chi")
def q_chi2_scores(spark, sf_dir):
    """Per-variant chi-square statistic of dosage vs region label (long form)."""
    scores, _ = _chi2(spark, sf_dir)
    return report(scores)


@register("chi2_select", CHI2_SQL + f"""select variant_key, round(statistic, 6) statistic from (
  select vi, statistic, row_number() over (order by round(statistic, 9) desc, vi) rk from chi) t
  join var using (vi) where rk <= {CHI2_TOP}""")
def q_chi2_select(spark, sf_dir):
    """Top-20 variants by chi-square (distributed top-k), named by key."""
    scores, variants = _chi2(spark, sf_dir, dense_variants=False)
    top = sel.select_top(scores, CHI2_TOP)
    return report(top.join(variants, "variant_index").select("variant_key", "statistic"))


@register("mann_whitney", CHI2_SQL + """, rk AS (select vi, rank() over (order by statistic) +
  (count(*) over (partition by statistic) - 1) / 2.0 r, case when vi in (select vi from var where variant_key % 40 = 0)
  then 1 else 0 end g from chi)
select cast(sum(g) as bigint) n1, cast(sum(1 - g) as bigint) n2,
  round(sum(case when g = 1 then r else 0 end) - sum(g) * (sum(g) + 1) / 2.0, 6) u,
  round((sum(case when g = 1 then r else 0 end) - sum(g) * (sum(g) + 1) / 2.0 - sum(g) * sum(1 - g) / 2.0)
        / sqrt(sum(g) * sum(1 - g) * (count(*) + 1) / 12.0), 6) z from rk""")
def q_mann_whitney(spark, sf_dir):
    """Mann-Whitney U of planted variants' chi-square ranks vs the rest (tie-averaged ranks)."""
    scores, variants = _chi2(spark, sf_dir)
    flagged = scores.join(variants, "variant_index").select(
        F.round("statistic", 9).alias("statistic"), (F.col("variant_key") % 40 == 0).alias("planted"))
    return report(metrics.mann_whitney(flagged, "statistic", "planted"))


RBO_DEPTH = 50
RBO_P = 0.9


@register("rbo", with_ctes([fixtures.F1_SQL, f"""ra AS (select variant_key, row_number() over
  (order by count(*) desc, variant_key) rank from flat group by variant_key order by rank limit {RBO_DEPTH})""",
    f"""rb AS (select variant_key, row_number() over (order by sum(allele * allele) desc, variant_key) rank
  from flat group by variant_key order by rank limit {RBO_DEPTH})""",
    f"""w AS (select k, sum((1 - {RBO_P}) * pow({RBO_P}, k - 1) / k) over (order by k desc) w
  from (select range k from range(1, {RBO_DEPTH + 1})) t)"""]) + """
select round(coalesce(sum(w.w), 0), 6) rbo from ra join rb using (variant_key)
  join w on w.k = greatest(ra.rank, rb.rank)""")
def q_rbo(spark, sf_dir):
    """Rank-biased overlap of two variant rankings (carrier count vs squared dosage), depth 50."""
    f = fixtures.flat(spark, sf_dir)
    g = f.groupBy("variant_key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("allele") ** 2).alias("s"))
    ta = g.orderBy(F.col("c").desc(), "variant_key").limit(RBO_DEPTH)
    tb = g.orderBy(F.col("s").desc(), "variant_key").limit(RBO_DEPTH)
    ra = ta.select("variant_key", F.row_number().over(Window.orderBy(F.col("c").desc(), "variant_key")).alias("rank"))
    rb = tb.select("variant_key", F.row_number().over(Window.orderBy(F.col("s").desc(), "variant_key")).alias("rank"))
    return report(metrics.rank_biased_overlap(ra, rb, "variant_key", RBO_DEPTH, RBO_P))


@register("encodings", with_ctes([fixtures.F1_SQL]) + """select subject_id, sum(allele) additive,
  cast(sum(case when allele > 0 then 1 else 0 end) as double) dominant,
  cast(sum(case when allele >= 2 then 1 else 0 end) as double) recessive,
  cast(sum(case when allele = 1 then 1 else 0 end) as double) heterosis from flat group by subject_id""")
def q_encodings(spark, sf_dir):
    """Additive / dominant / recessive / heterosis genotype encodings, summed per subject."""
    f = fixtures.flat(spark, sf_dir)
    return report(f.groupBy("subject_id").agg(*[F.sum(encode("allele", e)).alias(e) for e in
                                                ("additive", "dominant", "recessive", "heterosis")]))


GENES_SQL = """genes AS (select concat(upper(replace(p_name, ' ', '_')), '_', cast(p_partkey as varchar)) gene,
  cast((p_partkey * 7) % 22 + 1 as varchar) contig, p_partkey * 100 + p_size * 1000 gstart,
  p_partkey * 100 + p_size * 1000 + p_size * 500 gend from part)"""


def _genes(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    start = F.col("p_partkey") * 100 + F.col("p_size") * 1000
    return p.select(F.concat(F.upper(F.regexp_replace("p_name", " ", "_")), F.lit("_"),
                             F.col("p_partkey").cast("string")).alias("gene"),
                    ((F.col("p_partkey") * 7) % 22 + 1).cast("string").alias("contig"),
                    start.alias("start"), (start + F.col("p_size") * 500).alias("end"))


@register("annotate_gene", with_ctes([fixtures.F1_SQL, GENES_SQL, """v AS (select distinct variant_key,
  cast(variant_key % 22 + 1 as varchar) contig, variant_key * 100 pos from flat)""", """pr AS (
  select v.variant_key, g.gene, case when v.pos < g.gstart then g.gstart - v.pos when v.pos > g.gend
    then v.pos - g.gend else 0 end distance from v join genes g on g.contig = v.contig)"""]) + """
select variant_key, gene, cast(distance as bigint) distance, n_genes from (
  select variant_key, gene, distance, row_number() over (partition by variant_key order by distance, gene) rn,
         count(*) over (partition by variant_key) n_genes from pr where distance <= 100000) t where rn = 1""")
def q_annotate_gene(spark, sf_dir):
    """Nearest gene within 100 kb of each variant (binned range join)."""
    v = fixtures.flat(spark, sf_dir).select("variant_key").distinct().select(
        "variant_key", (F.col("variant_key") % 22 + 1).cast("string").alias("contig"),
        (F.col("variant_key") * 100).alias("pos"))
    return report(annotate.nearest_gene(annotate.genes_near(v, _genes(spark, sf_dir))))


# ---------------------------------------------------------------- sampling (R)

SUBJECTS_SQL = [fixtures.F1_SQL, "subjects AS (select distinct subject_id from flat)"]


def _subject_hash_sql(seed) -> str:
    return mixed_sql(seed, text_key_sql("subject_id"))


@register("split_hash", with_ctes(SUBJECTS_SQL) + f"""select subject_id,
  cast(case when {_subject_hash_sql(3)} < {below(0.8)} then 0 else 1 end as bigint) split from subjects""")
def q_split_hash(spark, sf_dir):
    """Stable 80/20 split of subjects by hash."""
    s = fixtures.flat(spark, sf_dir).select("subject_id").distinct()
    return report(sampling.split_hash(s, "subject_id", [0.8, 0.2], seed=3))


@register("split_repeated", with_ctes(SUBJECTS_SQL) + f"""select subject_id, cast(run_id as bigint) run_id,
  cast(case when {_subject_hash_sql("run_id")} < {below(0.75)} then 0 else 1 end as bigint) split
  from subjects, range(10) r(run_id)""")
def q_split_repeated(spark, sf_dir):
    """R2: ten seeded 75/25 splits as a run_id column."""
    s = fixtures.flat(spark, sf_dir).select("subject_id").distinct()
    return report(sampling.split_repeated(s, "subject_id", [0.75, 0.25], 10))


@register("folds", with_ctes(SUBJECTS_SQL) + f"""select subject_id,
  cast((row_number() over (order by {_subject_hash_sql(5)}, subject_id) - 1) % 10 as bigint) fold from subjects""")
def q_folds(spark, sf_dir):
    """10 folds of subjects with sizes differing by at most one."""
    s = fixtures.flat(spark, sf_dir).select("subject_id").distinct()
    return report(sampling.folds(s, "subject_id", 10, seed=5))


@register("sample_variants", with_ctes([fixtures.F1_SQL]) +
          f"select * from flat where {mixed_sql(9, 'variant_key')} < {below(0.1)}")
def q_sample_variants(spark, sf_dir):
    """Genome-wide hash sample of 10% of the variants (whole variants kept)."""
    f = fixtures.flat(spark, sf_dir)
    return report(sampling.sample_variants(f, "variant_key", 0.1, seed=9))


@register("subsample", with_ctes(SUBJECTS_SQL) +
          f"select subject_id from subjects order by {_subject_hash_sql(8)}, subject_id limit 20")
def q_subsample(spark, sf_dir):
    """Exactly 20 subjects, or all where there are fewer, chosen by hash order."""
    s = fixtures.flat(spark, sf_dir).select("subject_id").distinct()
    return report(sampling.subsample(s, "subject_id", size=min(20, s.count()), seed=8))
