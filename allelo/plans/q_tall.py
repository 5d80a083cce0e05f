"""Registered queries: tall ML pipelines, warm-started k-means, cluster reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelo import fixtures
from allelo.operators import forest as fr
from allelo.operators import kmeans as km
from allelo.operators import matrix as mx
_tile = mx.tile_for
from allelo.operators import metrics, sampling, tall_forest
from allelo.operators import select as sel
from allelo.operators.indexing import class_index, dense_index
from allelo.functions.hashing import SPACE, below, mixed_sql, text_key_sql
from allelo.plans import tall
from allelo.plans.common import KMEANS_TOL, indexed, kmeans_sql, with_ctes
from allelo.plans.forest_sql import importance_sql
from allelo.plans.q_ml import FOREST_MTRY, FOREST_TREES, random_forest_sql
from allelo.plans.registry import register, report
from allelo.session import scratch_path

REGIONS_SQL = [fixtures.F8_SQL, fixtures.F2_SQL, """sub AS (select s.subject_id, l.label from
  (select distinct subject_id from planted) s join panel on panel.sample = s.subject_id join
  (select super_pop, row_number() over (order by super_pop) - 1 label from (select distinct super_pop from panel) t) l
  using (super_pop))"""]


def _split_sql(seed, fraction) -> str:
    return f"case when {mixed_sql(seed, text_key_sql('subject_id'))} < {below(fraction)} then 0 else 1 end"


def _errors(pred, train):
    """``n_test, majority_error, better``: the test error of always the most frequent training label, and
    whether the predictions' error is no larger."""
    common = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    return pred.agg(F.count(F.lit(1)).alias("n_test"),
                    F.avg((F.col("label") != common).cast("double")).alias("majority_error"),
                    (F.avg((F.col("label") != F.col("prediction")).cast("double"))
                     <= F.avg((F.col("label") != common).cast("double"))).cast("bigint").alias("better"))


def _errors_sql(where: str, train: str) -> str:
    return f"""select count(*) n_test, round(avg(case when label <> (select label from sub where {train} group by label
  order by count(*) desc, label limit 1) then 1.0 else 0.0 end), 6) majority_error, cast(1 as bigint) better
  from sub where {where}"""


def _labelled(spark, sf_dir):
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    p = fixtures.panel(spark, sf_dir)
    lab = class_index(p, "super_pop", "label")
    labels = (subjects.join(p, subjects.subject_id == p["sample"]).join(lab, "super_pop")
              .select(F.col("subject_index").alias("sample_index"), "subject_id", "super_pop",
                      F.col("label").cast("double").alias("label")))
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    return cells, labels, variants, subjects


def _tall(spark, sf_dir):
    """Sparse vectors over all variants for every labelled sample (S14), and the variants behind the features."""
    cells, labels, variants, subjects = _labelled(spark, sf_dir)
    vec, d, feats = tall.tall_vectors(cells, labels)
    return labels.join(vec, "sample_index").checkpoint(), d, feats


@register("label_index", with_ctes([fixtures.F2_SQL]) + """select super_pop, cast(row_number() over
  (order by count(*) desc, super_pop) - 1 as double) label_index from panel group by super_pop""")
def q_label_index(spark, sf_dir):
    """StringIndexer label order (frequency, ties alphabetical) over the panel's super-population."""
    p = fixtures.panel(spark, sf_dir).select("super_pop")
    idx, back = tall.label_index(p, "super_pop")
    out = idx.transform(p).select("super_pop", "label_index").distinct()
    return report(back.transform(out).where(F.col("super_pop_back") == F.col("super_pop"))
                  .select("super_pop", "label_index"))


@register("kmeans_tall", with_ctes(REGIONS_SQL) + """
select (select count(*) from sub) n_subjects, round((select sum(allele * allele) from planted) -
  (select sum(s * s) from (select sum(allele) s from planted group by variant_key) t) / (select count(*) from sub), 3)
  one_cluster_cost, cast(1 as bigint) better""")
def q_kmeans_tall(spark, sf_dir):
    """M1 / M2: tall k-means on all variants; its cost against that of one cluster, which SQL knows."""
    cells, labels, _, _ = _labelled(spark, sf_dir)
    data = labels.join(tall.tall_vectors(cells, labels)[0], "sample_index")
    model, pred = tall.tall_kmeans(data, 5, seed=3)
    squares = cells.agg(F.sum(F.col("allele") * F.col("allele"))).first()[0]
    means = cells.groupBy("variant_index").agg(F.sum("allele").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    out = pred.where("prediction between 0 and 4").agg(F.count(F.lit(1)).alias("n_subjects"))
    cost = F.lit(float(squares)) - F.lit(float(means)) / F.col("n_subjects")
    return report(out.select("n_subjects", F.round(cost, 3).alias("one_cluster_cost"),
                             (F.lit(model.summary.trainingCost) <= cost).cast("bigint").alias("better")))


def _split(spark, sf_dir, fraction=0.8, seed=7):
    data, _, _ = _tall(spark, sf_dir)
    s = sampling.split_hash(data, "subject_id", [fraction, 1 - fraction], seed=seed)
    return s.where("split = 0"), s.where("split = 1")


@register("rf_tall", with_ctes(REGIONS_SQL) + _errors_sql(f"{_split_sql(7, 0.8)} = 1", f"{_split_sql(7, 0.8)} = 0"))
def q_rf_tall(spark, sf_dir):
    """Tall random forest (categories as VectorIndexer's) on all variants, hash 80/20 split, test error against the majority's."""
    train, test = _split(spark, sf_dir)
    model = tall.rf_classifier(train, n_trees=50, max_depth=5, subset="onethird", seed=3)
    return report(_errors(model.transform(test), train))


@register("rf_reg", with_ctes(REGIONS_SQL) + f"""
select (select count(*) from sub where {_split_sql(7, 0.8)} = 0) n_train, count(*) n_test, round(sqrt(avg(
  (label - (select avg(label) from sub where {_split_sql(7, 0.8)} = 0)) * (label - (select avg(label) from sub where {_split_sql(7, 0.8)} = 0)))), 6)
  mean_rmse, cast(1 as bigint) fits, cast(1 as bigint) holds from sub where {_split_sql(7, 0.8)} = 1""")
def q_rf_reg(spark, sf_dir):
    """Tall random-forest regressor of a numeric trait (the region's code), trained on 80%.

    It must fit (training error at most 0.9 of the mean's) and hold (test error at most 1.2 of the training mean's).
    """
    train, test = (d.withColumn("y", F.col("label").cast("double")) for d in _split(spark, sf_dir))
    model = tall.rf_regressor(train, n_trees=50, max_depth=8, seed=3)
    mean = train.agg(F.avg("y")).first()[0]
    rmse = lambda c: F.sqrt(F.avg((F.col("y") - c) * (F.col("y") - c)))
    ratio = rmse(F.col("prediction")) / F.nullif(rmse(F.lit(mean)), F.lit(0.0))
    fitted = model.transform(train).agg(F.count(F.lit(1)).alias("n_train"),
                                        (F.coalesce(ratio, F.lit(0.0)) <= 0.9).cast("bigint").alias("fits"))
    held = model.transform(test).agg(F.count(F.lit(1)).alias("n_test"), rmse(F.lit(mean)).alias("mean_rmse"),
                                     (F.coalesce(ratio, F.lit(0.0)) <= 1.2).cast("bigint").alias("holds"))
    return report(fitted.crossJoin(held))  # one row each


@register("logreg_cv", with_ctes(REGIONS_SQL) + _errors_sql(f"{_split_sql(7, 0.8)} = 1", f"{_split_sql(7, 0.8)} = 0"))
def q_logreg_cv(spark, sf_dir):
    """Logistic regression (maxIter 10, regParam 0.01) with 5-fold cross-validation on F1, on all variants."""
    train, test = _split(spark, sf_dir)
    cv = tall.logreg_cv(train, folds=5)
    return report(_errors(cv.transform(test), train))


@register("logreg_optimum", with_ctes(REGIONS_SQL) + """select cast(label as bigint) label, count(*) n,
  round(count(*) / cast((select count(*) from sub) as double), 4) mean_probability, cast(0.0 as double) gradient
from sub group by label""")
def q_logreg_optimum(spark, sf_dir):
    """The fitted regression against the optimum: classes' mean probabilities are their shares, the gradient is 0."""
    data, _, feats = _tall(spark, sf_dir)
    cells, _, _, _ = _labelled(spark, sf_dir)
    cells = cells.join(feats, "variant_index").select("sample_index", "feature", "allele")
    out = tall.logreg_optimum(data, cells, 0.01, scratch_path(spark, "logreg"))
    return report(out.select(F.col("cls").alias("label"), "n", F.round("mean_probability", 4).alias("mean_probability"),
                             F.round("gradient", 3).alias("gradient")))


@register("rf_importance", with_ctes([fixtures.F8_SQL]) + """select count(distinct variant_key) n_features,
  cast(1.0 as double) total, cast(1 as bigint) named from planted""")
def q_rf_importance(spark, sf_dir):
    """Tall RF feature importances, named by variant: they cover all features and add up to 1."""
    data, d, feats = _tall(spark, sf_dir)
    model = tall.rf_classifier(data, n_trees=20, max_depth=5, seed=3)
    imp = tall.saved_importances(model.stages[-1], scratch_path(spark, "importances"),
                                 feats.select("feature", "variant_index"))
    return report(imp.agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total"),
                          (F.count("variant_index") == d).cast("bigint").alias("named")))


@register("model_io", with_ctes(REGIONS_SQL) + "select subject_id, cast(1 as bigint) agrees from sub")
def q_model_io(spark, sf_dir):
    """Save a fitted tall forest, reload it and compare both models' predictions of every subject."""
    data, _, _ = _tall(spark, sf_dir)
    model = tall.rf_classifier(data, n_trees=5, max_depth=3, seed=3)
    path = scratch_path(spark, "model")
    model.save(path)
    back = tall_forest.load(spark, path).transform(data).select("subject_id", F.col("prediction").alias("again"))
    both = model.transform(data).select("subject_id", "prediction").join(back, "subject_id")
    return report(both.select("subject_id", (F.col("prediction") == F.col("again")).cast("bigint").alias("agrees")))


WARM_C0 = [fixtures.F2_SQL, """lab AS (select si, label from subj join panel on panel.sample = subj.subject_id join
  (select super_pop, row_number() over (order by super_pop) - 1 label from (select distinct super_pop from panel) t) l
  using (super_pop))""", """c0 AS (select l.label cl, x.vi, sum(x.allele) / max(n.n) c from x join lab l using (si)
  join (select label, count(*) n from lab group by label) n on n.label = l.label group by l.label, x.vi)"""]


@register("kmeans_warm", with_ctes(kmeans_sql("planted", 5, c0_sql=WARM_C0), True) +
          "select subject_id, cast(cl as bigint) cluster, round(dist, 6) distance, rounds from a join subj using (si), ended")
def q_kmeans_warm(spark, sf_dir):
    """M5: k-means warm-started from per-region mean centres, until the tolerance of 1e-3 stops it."""
    cells, labels, variants, subjects = _labelled(spark, sf_dir)
    x = cells.select(F.col("sample_index").alias("subject_index"), "variant_index", "allele")
    n_lab = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    init_long = (x.join(labels.select(F.col("sample_index").alias("subject_index"), "label"), "subject_index")
                 .groupBy("label", "variant_index").agg(F.sum("allele").alias("s"))
                 .join(n_lab, "label")
                 .select(F.col("label").cast("bigint").alias("cluster"), "variant_index",
                         (F.col("s") / F.col("n")).alias("c")))
    res = km.fit(x, subjects, 5, init_centres=km.centres_from_long(init_long, 5), tol=KMEANS_TOL)
    out = res.assignment.join(subjects, "subject_index").select("subject_id", "cluster", "distance",
                                                                F.lit(res.iterations).alias("rounds"))
    return report(out)


@register("cluster_vs_panel", with_ctes(kmeans_sql("planted", 5) + [fixtures.F2_SQL], True) + """select
  subj.subject_id, cast(a.cl as bigint) cluster, panel.super_pop, cast(l.label as bigint) label
  from a join subj using (si) join panel on panel.sample = subj.subject_id
  join (select super_pop, row_number() over (order by super_pop) - 1 label
        from (select distinct super_pop from panel) t) l using (super_pop)""")
def q_cluster_vs_panel(spark, sf_dir):
    """Predictions joined to the panel by individual and to the label dictionary."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    res = km.fit(x, subjects, 5, tol=KMEANS_TOL)
    p = fixtures.panel(spark, sf_dir)
    lab = class_index(p, "super_pop", "label")
    out = (res.assignment.join(subjects, "subject_index")
           .join(p, F.col("subject_id") == p["sample"]).join(lab, "super_pop")
           .select("subject_id", "cluster", "super_pop", "label").orderBy("cluster", "subject_id"))
    return report(out)


@register("cluster_populations", with_ctes(kmeans_sql("planted", 5) + [fixtures.F2_SQL], True) + """select
  cast(cl as bigint) cluster, string_agg(pop || ':' || cast(n as varchar), ',' order by pop) populations from (
  select a.cl, panel.pop, count(*) n from a join subj using (si) join panel on panel.sample = subj.subject_id
  group by a.cl, panel.pop) t group by cl""")
def q_cluster_populations(spark, sf_dir):
    """Cluster members mapped to pedigree populations, counted per (cluster, population)."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    res = km.fit(x, subjects, 5, tol=KMEANS_TOL)
    p = fixtures.panel(spark, sf_dir).select(F.col("sample").alias("subject_id"), "pop")
    c = (res.assignment.join(subjects, "subject_index").join(p, "subject_id")
         .groupBy("cluster", "pop").agg(F.count(F.lit(1)).alias("n")))
    out = c.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pop", "n"))),
                                                            lambda s: F.concat(s["pop"], F.lit(":"),
                                                                               s["n"].cast("string"))), ",")
                                   .alias("populations"))
    return report(out)


STABLE_TOP, STABLE_SEED = 5, 21


@register("importance_stability", with_ctes(random_forest_sql(FOREST_TREES, STABLE_SEED) + [importance_sql()], True) + f"""
select variable, count(*) n_models, round(sum(importance), 6) total_importance from (
  select *, row_number() over (partition by tree order by round(importance, 9) desc, variable) rk from imp) t
where rk <= {STABLE_TOP} group by variable""")
def q_importance_stability(spark, sf_dir):
    """How often each variable is among a tree's top-5 importances across the forest's trees."""
    cells, labels, variants, subjects = _labelled(spark, sf_dir)
    model = fr.fit(cells, labels.select("sample_index", F.col("label").cast("int").alias("label")), 5,
                   fr.ForestParams(n_trees=FOREST_TREES, mtry_fraction=FOREST_MTRY, seed=STABLE_SEED))
    per_tree = fr.importance(model.nodes, 1, by=("tree",)).withColumnRenamed("tree", "model_id")
    return report(fr.importance_stability(per_tree, STABLE_TOP))


SIMILAR, SAMPLE_SEED = 0.1, 13
SAMPLED_SQL = [fixtures.F1_SQL,
               "subj AS (select subject_id, row_number() over (order by subject_id) - 1 si "
               "from (select distinct subject_id from flat) d)",
               "x AS MATERIALIZED (select si, variant_key vi, allele from flat join subj using (subject_id))",
               f"scale AS (select sqrt(10.0 * ln(cast(greatest(count(*), 2) as double)) / {SIMILAR}) s from subj)",
               "len AS (select si, sqrt(sum(allele * allele)) l from x group by si)",
               f"""kept AS MATERIALIZED (select x.si, x.vi, allele / least(s, l) a from x join len using (si), scale
  where {mixed_sql(SAMPLE_SEED, 'x.vi', 'x.si')} < least(1.0, s / l) * {SPACE})""",
               """estimate AS (select p.si i, q.si j, sum(p.a * q.a) cosine from kept p join kept q on p.vi = q.vi and p.si < q.si
  group by p.si, q.si)""",
               """exact AS (select p.si i, q.si j, sum(p.allele * q.allele) / any_value(lp.l * lq.l) cosine from x p
  join x q on p.vi = q.vi and p.si < q.si join len lp on lp.si = p.si join len lq on lq.si = q.si group by p.si, q.si)"""]


def _cosines(spark, sf_dir):
    long, subjects, variants, x = indexed(spark, sf_dir, dense_variants=False)
    n = subjects.count()
    return x, n, mx.sampled_cosine(x, n, SIMILAR, SAMPLE_SEED)


@register("cosine_sampled", with_ctes(SAMPLED_SQL) + f"""select i, j, round(cosine, 6) cosine from estimate
  where round(cosine, 9) >= {SIMILAR}""")
def q_cosine_sampled(spark, sf_dir):
    """Estimated cosine similarities at or above the threshold, by cells sampled by their column's length."""
    _, _, estimate = _cosines(spark, sf_dir)
    return report(estimate.where(F.round("cosine", 9) >= SIMILAR))


@register("cosine_mae", with_ctes(SAMPLED_SQL) + """
select round(avg(abs(e.cosine - coalesce(p.cosine, 0))), 6) mae, count(*) n_pairs
from exact e left join estimate p using (i, j)""")
def q_cosine_mae(spark, sf_dir):
    """Mean absolute error of the sampled similarities against the exact ones (no estimate: 0)."""
    x, n, estimate = _cosines(spark, sf_dir)
    exact = mx.cosine_similarity(x, n).where("i < j")
    j = exact.join(estimate.withColumnRenamed("cosine", "approx"), ["i", "j"], "left").fillna(0.0, ["approx"])
    return report(j.agg(F.avg(F.abs(F.col("cosine") - F.col("approx"))).alias("mae"),
                        F.count(F.lit(1)).alias("n_pairs")))


@register("param_grid", with_ctes(REGIONS_SQL) + """select cast(d as bigint) max_depth, cast(b as bigint) max_bins,
  (select count(*) from sub) n, cast(1 as bigint) scored from (values (2), (4)) t(d), (values (16), (32)) u(b)""")
def q_param_grid(spark, sf_dir):
    """maxDepth x maxBins grid for the tall forest, every point scored by 3-fold cross-validation."""
    from pyspark.ml.classification import RandomForestClassifier
    data, _, _ = _tall(spark, sf_dir)
    rf = RandomForestClassifier()  # names the grid's parameters
    grid = [(int(p[rf.maxDepth]), int(p[rf.maxBins])) for p in tall.param_grid(rf, depths=(2, 4), bins=(16, 32))]
    params = tall_forest.TallParams(n_trees=5, categories=0, seed=3)
    accuracy = tall_forest.grid_accuracy(data, grid, params, folds=3)
    n = data.count()
    rows = [(depth, bins, n, int(0 < m <= 1)) for (depth, bins), m in zip(grid, accuracy, strict=True)]
    return report(spark.createDataFrame(rows, "max_depth int, max_bins int, n long, scored int"))
