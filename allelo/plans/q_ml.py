"""Registered queries: wide decision tree / forest, votes, importances."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelo import fixtures
from allelo.operators import forest as fr
from allelo.operators import metrics
from allelo.operators.indexing import class_index
from allelo.plans import forest_sql as fsql
from allelo.plans.common import indexed, sql_indexed, subject_index, with_ctes
from allelo.plans.registry import register, report
from allelo.tables import load

N_LABELS_SQL = 5          # region table: five super-populations
LAB_SQL = """lab AS (select si, label from subj join panel on panel.sample = subj.subject_id join
  (select super_pop, row_number() over (order by super_pop) - 1 label from (select distinct super_pop from panel) t) l
  using (super_pop))"""


def _base_sql():
    return sql_indexed("planted") + [fixtures.F2_SQL, LAB_SQL]


def _inputs(spark, sf_dir, dense_variants=True):
    """Cells of F8 with dense sample indices and region labels (all subjects are labelled).

    ``dense_variants=False`` identifies variables by variant key (same order, no dictionary).
    """
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=dense_variants)
    p = fixtures.panel(spark, sf_dir)
    lab = class_index(p, "super_pop", "label")
    labels = (subjects.join(p, subjects.subject_id == p["sample"]).join(lab, "super_pop")
              .select(F.col("subject_index").alias("sample_index"), "label"))
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    return cells, labels, lab.count(), variants


def _root_scores(spark, sf_dir, kind="gini"):
    cells, labels, L, variants = _inputs(spark, sf_dir)
    x = fr.prepare_cells(cells)
    labels = labels.checkpoint()
    state = fr.root_state(labels)
    totals = fr._node_totals(state, labels, L, kind)
    return fr.split_scores(x, state, labels, totals, L, 1.0, 0, kind, labels.count()), totals


@register("best_split", with_ctes(_base_sql() + ["s0 AS (select si, 1 node, 1 w from lab)"] + fsql.level_sql(0, N_LABELS_SQL, "gini", 1)) + """
select vi variable, threshold, round(weighted, 6) weighted from (
  select *, row_number() over (partition by vi order by round(weighted, 12), threshold) rn from sc0) q where rn = 1""")
def q_best_split(spark, sf_dir):
    """Best threshold of every variable at the root (Gini, region labels, F8)."""
    scores, _ = _root_scores(spark, sf_dir)
    best = scores.groupBy("variant_index").agg(F.min(F.struct(F.round("weighted", 12).alias("r"), "threshold",
                                                              "weighted")).alias("b"))
    return report(best.select(F.col("variant_index").alias("variable"), F.col("b.threshold").alias("threshold"),
                              F.col("b.weighted").alias("weighted")))


def _best_all_sql(kind):
    return with_ctes(_base_sql() + ["s0 AS (select si, 1 node, 1 w from lab)"] + fsql.level_sql(0, N_LABELS_SQL, kind, 1)) + """
select variable, threshold, majority, round(gain, 6) gain, round(impurity, 6) impurity, size from nd0"""


def _best_all(spark, sf_dir, kind):
    cells, labels, L, variants = _inputs(spark, sf_dir)
    model = fr.fit(cells, labels, L, fr.ForestParams(n_trees=1, mtry_fraction=1.0, max_depth=1, bootstrap=False,
                                                     impurity=kind))
    root = model.nodes.where(F.col("depth") == 0)
    return report(root.select("variable", "threshold", "majority", "gain", "impurity", "size"))


@register("best_split_all", _best_all_sql("gini"))
def q_best_split_all(spark, sf_dir):
    """M7: best split over all variables at the root, with gain, impurity and majority."""
    return _best_all(spark, sf_dir, "gini")


@register("entropy", _best_all_sql("entropy"))
def q_entropy(spark, sf_dir):
    """The same root split search with entropy impurity."""
    return _best_all(spark, sf_dir, "entropy")


def _tree(spark, sf_dir):
    cells, labels, L, variants = _inputs(spark, sf_dir)
    model = fr.fit(cells, labels, L, fr.ForestParams(n_trees=1, mtry_fraction=1.0, bootstrap=False))
    return model, labels, variants


TREE_CTES = _base_sql() + fsql.forest_sql(N_LABELS_SQL, "gini", "select 0 tree, si, 1 w from lab", 0, 1.0)


@register("tree_nodes", with_ctes(TREE_CTES, True) + """select depth, node, parent, side, variable, threshold, majority, round(gain, 6) gain,
  round(impurity, 6) impurity, size from nodes""")
def q_tree_nodes(spark, sf_dir):
    """Wide decision tree grown to the end (all variables tried, no bootstrap); the node listing."""
    model, *_ = _tree(spark, sf_dir)
    return report(model.nodes.select("depth", "node", "parent", "side", "variable", "threshold", "majority", "gain",
                                     "impurity", "size"))


@register("tree_predict", with_ctes(TREE_CTES + fsql.walk_sql("select 0 tree, si from lab"), True) +
          "select subject_id, prediction from pred join subj using (si)")
def q_tree_predict(spark, sf_dir):
    """M9: route every sample down the tree, looking up only split variables."""
    model, labels, variants = _tree(spark, sf_dir)
    start = labels.select("sample_index", F.lit(0).cast("bigint").alias("tree"))
    pred = fr.predict_trees(model.nodes, model.x, start)
    subjects = subject_index(spark, sf_dir, "planted")
    out = pred.join(subjects.select(F.col("subject_index").alias("sample_index"), "subject_id"), "sample_index")
    return report(out.select("subject_id", F.col("prediction").cast("bigint").alias("prediction")))


@register("importance", with_ctes(TREE_CTES + [fsql.importance_sql()], True) +
          "select variable, round(importance, 6) importance, n_splits from imp")
def q_importance(spark, sf_dir):
    """Gini variable importance of the grown tree."""
    model, *_ = _tree(spark, sf_dir)
    return report(fr.importance(model.nodes, 1))


@register("importance_top", with_ctes(TREE_CTES + [fsql.importance_sql()], True) +
          """select variant_key, round(importance, 6) importance from (
  select variable, importance, row_number() over (order by round(importance, 9) desc, variable) rk from imp) t
  join var on var.vi = t.variable where rk <= 5""")
def q_importance_top(spark, sf_dir):
    """Top-5 importances of the tree, named by variant key."""
    model, labels, variants = _tree(spark, sf_dir)
    imp = fr.importance(model.nodes, 1)
    top = imp.orderBy(F.round("importance", 9).desc(), "variable").limit(5)
    named = top.join(variants, top.variable == variants.variant_index)
    return report(named.select("variant_key", "importance"))


@register("vote", """select l_suppkey sample, cast(arg_max(l_linenumber, n * 1000 + l_linenumber) as bigint) vote,
  cast(sum(n) as bigint) n_votes from (select l_suppkey, l_linenumber, count(*) n from lineitem group by 1, 2) t
group by l_suppkey""")
def q_vote(spark, sf_dir):
    """Majority vote per sample (here: most frequent line number per supplier, ties -> largest)."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"),
                                                F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return report(metrics.majority_vote(li, ["sample"], "l_linenumber"))


# ---------------------------------------------------------------------------
# Random (hash-seeded) forests: the hash is plain integer arithmetic, so the
# bootstrap, the variables tried per node and the whole forest have SQL twins
# ---------------------------------------------------------------------------

FOREST_TREES, FOREST_SEED, FOREST_MTRY = 5, 11, 0.3
KEYED_SQL = [fixtures.F8_SQL, "subj AS MATERIALIZED (select subject_id, row_number() over (order by subject_id) - 1 si "
             "from (select distinct subject_id from planted) d)",
             "x AS MATERIALIZED (select si, variant_key vi, allele from planted join subj using (subject_id))",
             fixtures.F2_SQL, LAB_SQL]


def random_forest_sql(trees: int, seed: int) -> list[str]:
    """The seeded forest over variant keys: CTEs ``bag`` and ``nodes``."""
    return KEYED_SQL + fsql.forest_sql(N_LABELS_SQL, "gini", fsql.bootstrap_sql(trees, seed), seed, FOREST_MTRY)


NODES_SELECT = """select cast(tree as bigint) tree, depth, node, parent, side, variable, threshold, majority, round(gain, 6) gain,
  round(impurity, 6) impurity, size from nodes"""
NODE_LISTING = ("tree", "depth", "node", "parent", "side", "variable", "threshold", "majority", "gain", "impurity", "size")
EVERY_SQL = f"select tree, si from lab, range({FOREST_TREES}) t(tree)"


def _forest(spark, sf_dir):
    cells, labels, L, variants = _inputs(spark, sf_dir, dense_variants=False)
    params = fr.ForestParams(n_trees=FOREST_TREES, mtry_fraction=FOREST_MTRY, seed=FOREST_SEED)
    return fr.fit(cells, labels, L, params), labels


@register("forest_nodes", with_ctes(random_forest_sql(FOREST_TREES, FOREST_SEED), True) + NODES_SELECT)
def q_forest_nodes(spark, sf_dir):
    """5-tree wide random forest (bootstrap, 30% variables per node) grown to the end; node listing."""
    model, _ = _forest(spark, sf_dir)
    return report(model.nodes.select(*NODE_LISTING))


@register("oob_error", with_ctes(random_forest_sql(FOREST_TREES, FOREST_SEED) + fsql.walk_sql(
    EVERY_SQL + " where not exists (select 1 from bag b where b.tree = t.tree and b.si = lab.si)") + [
    f"cum AS (select t.tree, p.si, p.prediction, count(*) cv from pred p join range({FOREST_TREES}) t(tree) "
    "on p.tree <= t.tree group by 1, 2, 3)",
    "top AS (select tree, si, arg_max(prediction, cv * 100 + prediction) vote from cum group by tree, si)"], True) + f"""
select cast(t.tree as bigint) tree, round(avg(case when v.vote is null then null when v.vote <> lab.label then 1.0 else 0.0 end), 6) error,
  count(v.vote) n_voted, round(avg(case when coalesce(v.vote, {N_LABELS_SQL - 1}) <> lab.label then 1.0 else 0.0 end), 6) error_all
from range({FOREST_TREES}) t(tree) cross join lab left join top v on v.tree = t.tree and v.si = lab.si group by t.tree""")
def q_oob_error(spark, sf_dir):
    """Running out-of-bag error after each tree."""
    model, labels = _forest(spark, sf_dir)
    per_tree, _ = fr.out_of_bag(model, model.x, labels)
    return report(per_tree)


@register("forest_predict", with_ctes(random_forest_sql(FOREST_TREES, FOREST_SEED) + fsql.walk_sql(EVERY_SQL), True) + """
select cast(si as bigint) sample_index, cast(vote as bigint) vote, cast(n_votes as bigint) n_votes, cast(label as bigint) label
from (select si, arg_max(prediction, n * 100 + prediction) vote, sum(n) n_votes from
  (select si, prediction, count(*) n from pred group by 1, 2) c group by si) v join lab using (si)""")
def q_forest_predict(spark, sf_dir):
    """Majority vote of the forest per sample, next to the labels."""
    model, labels = _forest(spark, sf_dir)
    pred = fr.forest_predict(model, model.x, labels)
    return report(pred.join(labels, "sample_index"))


def _samples(spark, sf_dir):
    return subject_index(spark, sf_dir, "planted").select(F.col("subject_index").alias("sample_index"))


@register("bootstrap", with_ctes(KEYED_SQL + [f"bag AS ({fsql.bootstrap_sql(FOREST_TREES, FOREST_SEED)})"]) +
          "select cast(tree as bigint) tree, cast(si as bigint) sample_index, w from bag")
def q_bootstrap(spark, sf_dir):
    """Hash-seeded bootstrap multiplicities per (tree, sample); weights sum to n per tree."""
    samples = _samples(spark, sf_dir)
    return report(fr.bootstrap(samples, samples.count(), FOREST_TREES, FOREST_SEED))


@register("oob_samples", with_ctes(KEYED_SQL + [f"bag AS ({fsql.bootstrap_sql(FOREST_TREES, FOREST_SEED)})"]) + f"""
select cast(t.tree as bigint) tree, cast(lab.si as bigint) sample_index from lab cross join range({FOREST_TREES}) t(tree)
where not exists (select 1 from bag b where b.tree = t.tree and b.si = lab.si)""")
def q_oob_samples(spark, sf_dir):
    """Out-of-bag samples per tree (all samples minus the in-bag set)."""
    samples = _samples(spark, sf_dir)
    bag = fr.bootstrap(samples, samples.count(), FOREST_TREES, FOREST_SEED)
    trees = samples.select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(FOREST_TREES - 1))).alias("tree"))
    return report(trees.join(bag, ["tree", "sample_index"], "left_anti"))


# ---------------------------------------------------------------------------
# Forest with a given bag: every sample in every tree, multiplicity 1..3 by a
# fixed rule, so the whole forest (and its vote) has an exact SQL oracle.
# ---------------------------------------------------------------------------

BAG_TREES = 3
BAG_SQL = KEYED_SQL + fsql.forest_sql(
    N_LABELS_SQL, "gini",
    f"select tree, si, 1 + (si + tree) % 3 w from lab, range({BAG_TREES}) t(tree)", 0, 1.0)


def _bag_rule(sample, tree):
    return 1 + (sample + tree) % 3


def _bag_forest(spark, sf_dir):
    cells, labels, L, variants = _inputs(spark, sf_dir, dense_variants=False)
    bag = labels.select(F.explode(F.sequence(F.lit(0), F.lit(BAG_TREES - 1))).alias("tree"), "sample_index") \
        .select("tree", "sample_index", _bag_rule(F.col("sample_index"), F.col("tree")).cast("bigint").alias("w"))
    params = fr.ForestParams(n_trees=BAG_TREES, mtry_fraction=1.0, bootstrap=False)
    return fr.fit(cells, labels, L, params, bag=bag), labels


@register("forest_given_bag", with_ctes(BAG_SQL, True) + NODES_SELECT)
def q_forest_given_bag(spark, sf_dir):
    """3-tree wide forest grown level-wise from a given bag (sample multiplicities)."""
    model, labels = _bag_forest(spark, sf_dir)
    return report(model.nodes.select(*NODE_LISTING))


@register("forest_vote", with_ctes(BAG_SQL + fsql.walk_sql(
    f"select tree, si from lab, range({BAG_TREES}) t(tree)") + [
    "c AS (select si, prediction, count(*) n from pred group by si, prediction)"], True) + """
select subject_id, cast(arg_max(prediction, n * 10 + prediction) as bigint) vote, cast(sum(n) as bigint) n_votes
from c join subj using (si) group by subject_id""")
def q_forest_vote(spark, sf_dir):
    """Majority vote of the given-bag forest per sample (ties -> largest label)."""
    model, labels = _bag_forest(spark, sf_dir)
    pred = fr.forest_predict(model, model.x, labels)
    subjects = subject_index(spark, sf_dir, "planted")
    out = pred.join(subjects.select(F.col("subject_index").alias("sample_index"), "subject_id"), "sample_index")
    return report(out.select("subject_id", F.col("vote").cast("bigint").alias("vote"), "n_votes"))
