"""Registered queries: projector, cross-validation and repeated evaluation of wide forests, saved wide models.

Folds, splits, bags and variable draws are plain integer hashes, so whole evaluations
(every forest, every held-out vote, every metric) have SQL twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from allelo import fixtures
from allelo.functions.hashing import below, mixed_sql, text_key_sql
from allelo.operators import forest as fr
from allelo.operators import kmeans as km
from allelo.operators import metrics, model_store, sampling
from allelo.operators import validation as val
from allelo.operators.projector import Projector
from allelo.plans import forest_sql as fsql
from allelo.plans.common import KMEANS_TOL, indexed, kmeans_sql, sql_indexed, subject_index, with_ctes
from allelo.plans.q_ml import (BAG_SQL, BAG_TREES, FOREST_MTRY, KEYED_SQL, N_LABELS_SQL, _bag_forest, _inputs)
from allelo.plans.registry import register, report
from allelo.session import scratch_path

# ------------------------------------------------------------- P20: projector

PROJECT_SET = ["NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23"]


def _project_sql(negate: str) -> str:
    listed = ",".join(f"'{x}'" for x in PROJECT_SET)
    return with_ctes(sql_indexed() + [fixtures.F2_SQL, f"""keep AS (
  select si, row_number() over (order by si) - 1 ni from subj left join panel on panel.sample = subj.subject_id
  where coalesce(pop, '') {negate} in ({listed}))"""]) + "select x.vi variant_index, keep.ni sample_index, x.allele from x join keep using (si)"


def _projector(spark, sf_dir):
    """The cells of F1 and the projector of the listed populations' samples."""
    long, subjects, variants, x = indexed(spark, sf_dir)
    people = fixtures.panel(spark, sf_dir).where(F.col("pop").isin(PROJECT_SET)).select(F.col("sample").alias("subject_id"))
    every = subjects.withColumnRenamed("subject_index", "sample_index")
    cells = x.select("variant_index", F.col("subject_index").alias("sample_index"), "allele")
    return cells, every, Projector(every, every.join(people, "subject_id", "left_semi"))


@register("project_samples", _project_sql(""))
def q_project_samples(spark, sf_dir):
    """P20: cells of the chosen samples, re-indexed by the projector."""
    cells, _, chosen = _projector(spark, sf_dir)
    return report(chosen.project(cells))


@register("project_inverted", _project_sql("not"))
def q_project_inverted(spark, sf_dir):
    """The inverse projector: cells of all other samples, re-indexed."""
    cells, _, chosen = _projector(spark, sf_dir)
    return report(chosen.inverted.project(cells))


@register("project_dictionary", with_ctes(sql_indexed() + [fixtures.F2_SQL]) + f"""
select subject_id, cast(case when coalesce(pop in ({",".join(f"'{x}'" for x in PROJECT_SET)}), false) then 1 else 0 end as bigint) chosen,
  row_number() over (partition by coalesce(pop in ({",".join(f"'{x}'" for x in PROJECT_SET)}), false) order by si) - 1 sample_index
from subj left join panel on panel.sample = subj.subject_id""")
def q_project_dictionary(spark, sf_dir):
    """The subject dictionary under a projector and its inverse, as a pair."""
    _, every, chosen = _projector(spark, sf_dir)
    keep, drop = (p.project(every).withColumn("chosen", F.lit(flag)) for p, flag in zip(chosen.pair, (1, 0), strict=True))
    return report(keep.unionByName(drop))


# ------------------------------------- R8, M21, M22: evaluations in one growth

CV_FOLDS, CV_TREES, CV_SEED = 10, 2, 31
RUNS, RUN_TREES, RUN_SEED = 5, 3, 41
GRID_FOLDS, GRID_DEPTHS, GRID_MTRY = 3, (1, 2, 4), (0.1, 0.3)


def _fold_sql(k: int) -> list[str]:
    return [f"""fold AS (select si, (row_number() over (order by {mixed_sql(5, text_key_sql('subject_id'))}, subject_id) - 1) % {k} fold
  from subj join lab using (si))""",
            f"parts AS (select part, si, fold <> part train from fold, range({k}) p(part))"]


def _split_parts_sql(runs: int) -> list[str]:
    return [f"""parts AS (select part, si, {mixed_sql('part', text_key_sql('subject_id'))} < {below(0.75)} train
  from subj join lab using (si), range({runs}) p(part))"""]


def _held_out_sql(parts: list[str], n_parts: int, trees: int, seed: int, mtry: float) -> list[str]:
    """CTE ``held(part, si, label, prediction)``: every part's vote on the samples held out of it."""
    bag = f"""select b.tree, b.si, b.w from ({fsql.bootstrap_sql(n_parts * trees, seed)}) b
  join parts p on p.part = b.tree // {trees} and p.si = b.si where p.train"""
    start = f"select p.part * {trees} + t.t tree, p.si from parts p, range({trees}) t(t) where not p.train"
    return (KEYED_SQL + parts + fsql.forest_sql(N_LABELS_SQL, "gini", bag, seed, mtry) + fsql.walk_sql(start)
            + [_vote_sql(trees, "pred")])


def _vote_sql(trees: int, pred: str, name: str = "held") -> str:
    return f"""{name} AS MATERIALIZED (select part, si, label, arg_max(prediction, n * 100 + prediction) prediction from (
  select tree // {trees} part, si, prediction, count(*) n from {pred} group by 1, 2, 3) c join lab using (si) group by part, si, label)"""


#: error and ARI by part of ``held``
SCORES_SQL = """ct AS (select part, label a, prediction b, count(*) n from held group by 1, 2, 3),
sums AS (select part, sum(n) n, sum(n * (n - 1) / 2.0) idx, sum(case when a <> b then n else 0 end) wrong from ct group by part),
sum_a AS (select part, sum(m * (m - 1) / 2.0) sa from (select part, a, sum(n) m from ct group by 1, 2) t group by part),
sum_b AS (select part, sum(m * (m - 1) / 2.0) sb from (select part, b, sum(n) m from ct group by 1, 2) t group by part),
e AS (select *, case when n > 1 then sa * sb / (n * (n - 1) / 2.0) else 0.0 end e
  from sums join sum_a using (part) join sum_b using (part)),
scores AS (select cast(part as bigint) part, cast(n as bigint) n, cast(wrong as double) / n error,
  case when (sa + sb) / 2.0 - e = 0 then 1.0 else (idx - e) / ((sa + sb) / 2.0 - e) end ari from e)"""


def _labelled_folds(spark, sf_dir, k):
    cells, labels, L, _ = _inputs(spark, sf_dir, dense_variants=False)
    subjects = subject_index(spark, sf_dir, "planted").withColumnRenamed("subject_index", "sample_index")
    folds = sampling.folds(subjects.join(labels, "sample_index", "left_semi"), "subject_id", k, seed=5)
    return cells, labels, L, val.fold_parts(folds, k).checkpoint()


def _cross_validated(spark, sf_dir):
    cells, labels, L, parts = _labelled_folds(spark, sf_dir, CV_FOLDS)
    params = fr.ForestParams(n_trees=CV_TREES, mtry_fraction=FOREST_MTRY, seed=CV_SEED)
    model = val.fit_parts(cells, labels, parts, CV_FOLDS, L, params)
    return val.held_out(model, labels, parts, CV_TREES).checkpoint()


def _error(df, by):
    return metrics.classification_error(df, "label", "prediction", by)


def _ari(df, by):
    return metrics.adjusted_rand_index(df, "label", "prediction", by)


CV_SQL = with_ctes(_held_out_sql(_fold_sql(CV_FOLDS), CV_FOLDS, CV_TREES, CV_SEED, FOREST_MTRY) + [SCORES_SQL], True)


@register("cv_ari", CV_SQL + "select part fold, n, round(error, 6) error, round(ari, 6) ari from scores")
def q_cv_ari(spark, sf_dir):
    """10-fold cross-validation of wide forests grown together; error and ARI of every fold."""
    held = _cross_validated(spark, sf_dir)
    errors, _ = val.evaluate(held, _error, "error")
    aris, _ = val.evaluate(held, _ari, "ari")
    return report(errors.join(aris.select("part", "ari"), "part").withColumnRenamed("part", "fold"))


@register("forest_cv", CV_SQL + """select round(avg(error), 6) error, round(avg(ari), 6) ari, count(*) n_folds from scores""")
def q_forest_cv(spark, sf_dir):
    """The cross-validation means of two metrics of the same held-out votes."""
    held = _cross_validated(spark, sf_dir)
    _, error = val.evaluate(held, _error, "error")
    _, ari = val.evaluate(held, _ari, "ari")
    return report(error.select(F.col("mean").alias("error"), F.col("n_parts").alias("n_folds"))
                  .crossJoin(ari.select(F.col("mean").alias("ari"))))  # one row each


@register("rf_repeated", with_ctes(_held_out_sql(_split_parts_sql(RUNS), RUNS, RUN_TREES, RUN_SEED, FOREST_MTRY) + [SCORES_SQL], True)
          + """select s.part run_id, t.n_train, s.n n_test, round(s.error, 6) error, round(s.ari, 6) ari, round(p.precision, 6) "precision"
from scores s join (select part, count(*) n_train from parts where train group by part) t on t.part = s.part join (
  select part, avg(case when predicted > 0 then cast(tp as double) / predicted else 0.0 end) "precision" from (
    select a.part, a.cls, coalesce(sum(case when h.label = a.cls then 1 else 0 end), 0) tp, count(h.si) predicted
    from (select distinct part, label cls from held union select distinct part, prediction from held) a
    left join held h on h.part = a.part and h.prediction = a.cls group by 1, 2) c group by part) p on p.part = s.part""")
def q_rf_repeated(spark, sf_dir):
    """Seeded 75/25 splits, all forests grown together; error, ARI and mean precision of every run."""
    cells, labels, L, _ = _inputs(spark, sf_dir, dense_variants=False)
    subjects = subject_index(spark, sf_dir, "planted").withColumnRenamed("subject_index", "sample_index")
    splits = sampling.split_repeated(subjects.join(labels, "sample_index", "left_semi"), "subject_id", [0.75, 0.25], RUNS)
    parts = val.split_parts(splits).checkpoint()
    params = fr.ForestParams(n_trees=RUN_TREES, mtry_fraction=FOREST_MTRY, seed=RUN_SEED)
    model = val.fit_parts(cells, labels, parts, RUNS, L, params)
    held = val.held_out(model, labels, parts, RUN_TREES).checkpoint()
    errors, _ = val.evaluate(held, _error, "error")
    aris, _ = val.evaluate(held, _ari, "ari")
    precision = metrics.precision_recall(held, "label", "prediction", ("part",)).groupBy("part").agg(
        F.avg("precision").alias("precision"))
    sizes = parts.where("train").groupBy("part").agg(F.count(F.lit(1)).alias("n_train"))
    out = errors.join(aris.select("part", "ari"), "part").join(precision, "part").join(sizes, "part")
    return report(out.select(F.col("part").alias("run_id"), "n_train", F.col("n").alias("n_test"), "error", "ari", "precision"))


def _grid_sql(mtry: float, at: int) -> tuple[list[str], str]:
    """CTEs of the evaluation for one share of variables, and the accuracy by depth and part."""
    parts = _held_out_sql(_fold_sql(GRID_FOLDS), GRID_FOLDS, CV_TREES, CV_SEED + at, mtry)
    depths = " union all ".join(f"""select {d} max_depth, part, avg(case when label = prediction then 1.0 else 0.0 end) accuracy from (
  select part, si, label, arg_max(prediction, n * 100 + prediction) prediction from (
    select tree // {CV_TREES} part, si, prediction, count(*) n from (
      select tree, si, arg_max(majority, depth) prediction from walk where depth <= {d} group by tree, si) w group by 1, 2, 3) c
  join lab using (si) group by part, si, label) h group by part""" for d in GRID_DEPTHS)
    return parts, depths


def _forest_grid_sql() -> str:
    rows = []
    for at, mtry in enumerate(GRID_MTRY):
        parts, depths = _grid_sql(mtry, at)
        rows.append(f"select * from ({with_ctes(parts, True)} select cast({mtry} as double) mtry, max_depth, avg(accuracy) accuracy "
                    f"from ({depths}) d group by max_depth) m{at}")
    return "select mtry, cast(max_depth as bigint) max_depth, round(accuracy, 6) accuracy from (" + " union all ".join(rows) + ") g"


@register("forest_grid", _forest_grid_sql())
def q_forest_grid(spark, sf_dir):
    """Depth x share of variables for the wide forest, every point scored by the same folds.

    A tree cut at a depth is the tree grown no deeper, so one growth and one walk a share serve all
    depths; both shares grow on the same partitioned cells.
    """
    cells, labels, L, parts = _labelled_folds(spark, sf_dir, GRID_FOLDS)
    x, out = fr.prepare_cells(cells), None
    for at, mtry in enumerate(GRID_MTRY):
        params = fr.ForestParams(n_trees=CV_TREES, mtry_fraction=mtry, seed=CV_SEED + at, max_depth=max(GRID_DEPTHS))
        model = val.fit_parts(cells, labels, parts, GRID_FOLDS, L, params, x)
        held = val.held_out_depths(model, labels, parts, CV_TREES, GRID_DEPTHS).checkpoint()
        for depth in GRID_DEPTHS:
            _, mean = val.evaluate(held.where(F.col("max_depth") == depth), _error, "error")
            row = mean.select(F.lit(mtry).alias("mtry"), F.lit(depth).alias("max_depth"), (1.0 - F.col("mean")).alias("accuracy"))
            out = row if out is None else out.unionByName(row)
    return report(out)


# --------------------------------------------------------- D9: saved wide models


@register("forest_io", with_ctes(BAG_SQL + fsql.walk_sql(
    f"select tree, si from lab, range({BAG_TREES}) t(tree)") + [
    "c AS (select si, prediction, count(*) n from pred group by si, prediction)"], True) + """
select subject_id, cast(arg_max(prediction, n * 10 + prediction) as bigint) vote, cast(sum(n) as bigint) n_votes
from c join subj using (si) group by subject_id""")
def q_forest_io(spark, sf_dir):
    """A wide forest saved and loaded again; the loaded one's vote of every subject."""
    model, labels = _bag_forest(spark, sf_dir)
    params = fr.ForestParams(n_trees=BAG_TREES, mtry_fraction=1.0, bootstrap=False)
    path = model_store.save_forest(model, params, scratch_path(spark, "forest-model"))
    back, _ = model_store.load_forest(spark, path, model.x)
    pred = fr.forest_predict(back, back.x, labels)
    subjects = subject_index(spark, sf_dir, "planted")
    out = pred.join(subjects.select(F.col("subject_index").alias("sample_index"), "subject_id"), "sample_index")
    return report(out.select("subject_id", F.col("vote").cast("bigint").alias("vote"), "n_votes"))


@register("kmeans_io", with_ctes(kmeans_sql("planted", 5), True) +
          "select subject_id, cast(cl as bigint) cluster, round(dist, 6) distance from a join subj using (si)")
def q_kmeans_io(spark, sf_dir):
    """Converged centres saved and loaded again; every subject assigned to the loaded ones."""
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    fitted = km.fit(x, subjects, 5, tol=KMEANS_TOL)
    path = model_store.save_centres(fitted, 5, scratch_path(spark, "centres"))
    centres, k = model_store.load_centres(spark, path)
    a = km.assign(fitted.x, centres, subjects.select("subject_index"), k, subjects.count())
    return report(a.join(subjects, "subject_index").select("subject_id", "cluster", "distance"))
