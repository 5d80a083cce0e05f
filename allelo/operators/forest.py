"""Wide decision trees and random forests grown level by level.

Data: ``X(sample_index, variant_index, allele)`` non-zero cells, hash-partitioned
by ``variant_index`` once.  State: ``S(tree, sample_index, node, w)`` where ``w``
is the bootstrap multiplicity; it is trees x samples rows, i.e. cohort-sized.

One level for *all* trees and nodes at once:

1. node class totals ``tot_l`` from ``S join labels`` (small);
2. ``X join S`` (S broadcast when small) -> optional per-(tree, node, variable)
   hash subsample of variables -> ``groupBy(tree, node, variable, allele)``
   with one weighted count column per label.  The grouping keys contain
   ``variant_index``, so the aggregation reuses X's partitioning: no shuffle
   of the genotype cells;
3. the zero-dosage row of every candidate variable is ``tot - sum(non-zero)``;
4. running left counts over dosage per (tree, node, variable) give the left /
   right impurity of every threshold (threshold = largest value sent left);
5. best split per node by a partial-aggregated ``min(struct(...))``: lowest
   weighted impurity, ties to the smallest variable then threshold;
6. samples of split nodes look up the chosen variable (semi-join reduced X)
   and move to the left (allele <= threshold) or right child.

A node is known by its tree, its depth and its smallest sample, which no other
node of that tree and depth holds; ``parent`` (the name of the node above) and
``side`` link the levels, so trees may be of any depth.  A node is a leaf when no
candidate variable exists, the best gain is <= ``min_gain`` or the optional
``max_depth`` is reached; without one trees grow until no node gains.

Nodes whose samples hold at most ``local_cells`` cells are set aside on the way
down and finished in one grouped stage at the end (``subtree.py``): their cells
are brought together by node, and each task grows whole subtrees by the same
rules.  The bound counts cells, so a group's memory does not depend on the
cohort; how deep the levels above must go does.

X is partitioned once per fit and carried by the model for prediction.  Forests
whose state would exceed the broadcast bound are grown in batches of trees that
share this X.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelo.functions.hashing import below, mixed
from allelo.operators import subtree
from allelo.session import checkpoint_partitioned, discard, pinned, scratch_path

BROADCAST_ROWS = 2_000_000
LOCAL_CELLS = 32_000_000
#: rows that walk down one subtree together
WALK_ROWS = 100_000


@dataclass
class ForestParams:
    n_trees: int = 1
    mtry_fraction: float | None = None   # None -> sqrt(V)/V; 1.0 -> every variable
    max_depth: int | None = None         # None -> grow until no node gains
    min_gain: float = 1e-12
    bootstrap: bool = True
    impurity: str = "gini"               # or "entropy"
    seed: int = 17
    local_cells: int = LOCAL_CELLS       # cells of a node below which one task grows its whole subtree


NODE_COLUMNS = """tree long, depth long, node long, parent long, side long, variable long, threshold double,
  majority long, gain double, impurity double, size long, part_depth long, part long"""


@dataclass
class ForestModel:
    nodes: DataFrame        # NODE_COLUMNS; part_depth and part name the subtree root where one task grew it, else -1
    n_trees: int
    n_labels: int
    bag: DataFrame          # tree, sample_index, w
    x: DataFrame | None = None  # the partitioned cells it was grown on


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _impurity(counts: list[Column], n: Column, kind: str) -> Column:
    """Impurity of a side from its per-label counts (0 for an empty side)."""
    nd = n.cast("double")
    if kind == "gini":
        s2 = sum((c.cast("double") * c.cast("double") for c in counts), F.lit(0.0))
        val = 1.0 - s2 / (nd * nd)
    elif kind == "entropy":
        sl = sum((F.when(c > 0, c.cast("double") * F.log2(c.cast("double"))).otherwise(0.0) for c in counts),
                 F.lit(0.0))
        val = F.log2(nd) - sl / nd
    else:
        raise ValueError(kind)
    return F.when(n > 0, val).otherwise(F.lit(0.0))


def prepare_cells(cells: DataFrame, partitions: int | None = None) -> DataFrame:
    spark = cells.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = cells.select("sample_index", "variant_index", F.col("allele").cast("double").alias("allele"))
    return checkpoint_partitioned(c, parts, "variant_index")


def bootstrap(samples: DataFrame, n: int, n_trees: int, seed: int, with_replacement: bool = True) -> DataFrame:
    """Per tree, ``n`` draws with replacement -> ``(tree, sample_index, w)`` multiplicities.

    Draw ``d`` of tree ``t`` picks sample ``mixed(seed, t, d) % n``; the draw table is ``n_trees * n`` rows generated in parallel.  Requires dense
    sample indices ``0..n-1``.
    """
    spark = samples.sparkSession
    if not with_replacement:
        return samples.select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")) \
            .select("tree", "sample_index", F.lit(1).cast("bigint").alias("w"))
    draws = spark.range(n_trees * n).select((F.col("id") / n).cast("bigint").alias("tree"),
                                            (F.col("id") % n).alias("draw"))
    pick = mixed(seed, F.col("tree"), F.col("draw")) % F.lit(n).cast("bigint")
    return draws.groupBy("tree", pick.alias("sample_index")).agg(F.count(F.lit(1)).alias("w"))


def variable_pick(seed: int, fraction: float) -> Column:
    """Bernoulli(fraction) choice of a variable per (tree, node), as a hash predicate."""
    return mixed(seed, F.col("tree"), F.col("node"), F.col("variant_index")) < below(fraction)


def _with_labels(state: DataFrame, labels: DataFrame) -> DataFrame:
    return state if "label" in state.columns else state.join(labels, "sample_index")


def _node_totals(state: DataFrame, labels: DataFrame, n_labels: int, kind: str) -> DataFrame:
    sl = _with_labels(state, labels)
    tots = [F.sum(F.when(F.col("label") == l, F.col("w")).otherwise(0)).cast("bigint").alias(f"t{l}")
            for l in range(n_labels)]
    links = [c for c in ("parent", "side") if c in sl.columns]  # of one value in a node
    t = sl.groupBy("tree", "node", *links).agg(*tots)
    tcols = [F.col(f"t{l}") for l in range(n_labels)]
    size = sum(tcols[1:], tcols[0])
    majority = F.array_max(F.array(*[F.struct(F.col(f"t{l}").alias("c"), F.lit(l).alias("l"))
                                     for l in range(n_labels)]))["l"]
    return t.select("*", size.alias("size"), majority.alias("majority"),
                    _impurity(tcols, size, kind).alias("impurity"))


def split_scores(x: DataFrame, state: DataFrame, labels: DataFrame, totals: DataFrame, n_labels: int,
                 fraction: float, seed: int, kind: str, state_rows: int, n_nodes: int = 1) -> DataFrame:
    """Weighted impurity of every (tree, node, variable, threshold) candidate.

    Dosages are non-negative and zero cells are absent, so for a threshold
    ``t`` the right side holds the non-zero values ``> t``: a suffix sum over
    the distinct non-zero values of each (tree, node, variable), taken with one
    window whose partition keys contain ``variant_index`` (X's partitioning, so
    no exchange).  Candidate ``t = 0`` (zeros left, every non-zero right) comes
    from the smallest value's row; the left side is the node total minus the
    right side.
    """
    from pyspark.sql import Window

    sl = _with_labels(state, labels).select("tree", "node", "sample_index", "label", "w")
    cells = x.join(_small(sl, state_rows), "sample_index")
    if fraction < 1.0:
        cells = cells.where(variable_pick(seed, fraction))
    cnt = [F.sum(F.when(F.col("label") == l, F.col("w")).otherwise(0)).cast("bigint").alias(f"c{l}")
           for l in range(n_labels)]
    nz = cells.groupBy("tree", "node", "variant_index", "allele").agg(*cnt)
    part = Window.partitionBy("tree", "node", "variant_index")
    desc = part.orderBy(F.col("allele").desc())
    above = [F.coalesce(F.sum(f"c{l}").over(desc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
             for l in range(n_labels)]
    every = [F.sum(f"c{l}").over(part) for l in range(n_labels)]
    is_min = F.col("allele") == F.min("allele").over(part)

    win = nz.select("tree", "node", "variant_index", "allele", is_min.alias("is_min"),
                    *[a.alias(f"a{l}") for l, a in enumerate(above)],
                    *[e.alias(f"e{l}") for l, e in enumerate(every)])

    def cand(t, prefix):
        return F.struct(t.cast("double").alias("threshold"),
                        *[F.col(f"{prefix}{l}").cast("bigint").alias(f"r{l}") for l in range(n_labels)])

    at_value = cand(F.col("allele"), "a")
    at_zero = cand(F.lit(0.0), "e")
    rows = win.select("tree", "node", "variant_index",
                      F.explode(F.when(F.col("is_min"), F.array(at_value, at_zero))
                                .otherwise(F.array(at_value))).alias("k"))
    cand_rows = rows.select("tree", "node", "variant_index", "k.*").join(
        _small(totals.select("tree", "node", "size", *[f"t{l}" for l in range(n_labels)]), n_nodes), ["tree", "node"])
    right = [F.col(f"r{l}") for l in range(n_labels)]
    left = [F.col(f"t{l}") - F.col(f"r{l}") for l in range(n_labels)]
    nr = sum(right[1:], right[0])
    nl = F.col("size") - nr
    weighted = (_impurity(left, nl, kind) * nl + _impurity(right, nr, kind) * nr) / F.col("size").cast("double")
    return cand_rows.where((nr > 0) & (nl > 0)).select("tree", "node", "variant_index", "threshold",
                                                       weighted.alias("weighted"))


def best_splits(x: DataFrame, state: DataFrame, labels: DataFrame, totals: DataFrame, n_labels: int,
                fraction: float, seed: int, kind: str, state_rows: int, n_nodes: int = 1) -> DataFrame:
    """M7: best (variable, threshold, weighted impurity) per (tree, node)."""
    scored = split_scores(x, state, labels, totals, n_labels, fraction, seed, kind, state_rows, n_nodes)
    best = scored.groupBy("tree", "node").agg(F.min(F.struct(
        F.round("weighted", 12).alias("wr"), F.col("variant_index").alias("variable"), "threshold",
        "weighted")).alias("b"))
    return best.select("tree", "node", F.col("b.variable").alias("variable"),
                       F.col("b.threshold").alias("threshold"), F.col("b.weighted").alias("weighted"))


def _route(x: DataFrame, state: DataFrame, chosen_rows: int) -> DataFrame:
    """Rows that stand in split nodes, with the side they go to (missing cell = dosage 0).

    ``state`` carries the ``variable`` and ``threshold`` of its node.  Only the
    chosen variables' cells are read from X (semi-join reduction).
    """
    chosen = state.select(F.col("variable").alias("variant_index")).distinct()
    xv = x.join(_small(chosen, chosen_rows), "variant_index", "left_semi") \
        .select(F.col("variant_index").alias("variable"), "sample_index", "allele")
    routed = state.join(xv, ["variable", "sample_index"], "left")
    side = (F.coalesce(F.col("allele"), F.lit(0.0)) > F.col("threshold")).cast("bigint")
    return routed.withColumn("side", side).drop("variable", "threshold", "allele")


def root_state(labels: DataFrame) -> DataFrame:
    """All labelled samples at the root of a single unweighted tree."""
    return labels.select(F.lit(0).cast("bigint").alias("tree"), "sample_index",
                         F.lit(1).cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("w"))


def fit(cells: DataFrame, labels: DataFrame, n_labels: int, params: ForestParams,
        n_variables: int | None = None, bag: DataFrame | None = None,
        trees_per_batch: int | None = None, x: DataFrame | None = None) -> ForestModel:
    """M8 (one tree) / M10 (forest): grow trees level by level, as many at a time as the state bound allows.

    ``cells(sample_index, variant_index, allele)`` with dense sample indices
    ``0..n-1`` for exactly the labelled samples ``labels(sample_index, label)``.
    ``trees_per_batch`` bounds the state (batch x samples rows); trees do not
    depend on it.  Several fits on the same cells may share ``x``, these as
    ``prepare_cells`` gives them.
    """
    x = prepare_cells(cells) if x is None else x
    labels = labels.select("sample_index", F.col("label").cast("int").alias("label")).checkpoint()
    n = labels.count()
    frac = params.mtry_fraction
    if frac is None or (isinstance(frac, float) and math.isnan(frac)):
        if n_variables is None:
            n_variables = x.select("variant_index").distinct().count()
        frac = math.sqrt(n_variables) / n_variables if n_variables else 1.0
    if bag is None:
        bag = bootstrap(labels.select("sample_index"), n, params.n_trees, params.seed, params.bootstrap)
    bag = bag.select("tree", "sample_index", F.col("w").cast("bigint").alias("w")).checkpoint()
    batch = trees_per_batch or max(1, BROADCAST_ROWS // max(n, 1))
    per_sample = x.groupBy("sample_index").agg(F.count(F.lit(1)).alias("cells"))
    roots = (bag.join(labels, "sample_index").join(per_sample, "sample_index", "left")
             .select("tree", "sample_index", "w", "label", F.coalesce("cells", F.lit(0)).alias("cells"),
                     F.lit(-1).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("side")))
    grown = scratch_path(x.sparkSession, "forest")
    for start in range(0, params.n_trees, batch):
        part = roots if batch >= params.n_trees else \
            roots.where((F.col("tree") >= start) & (F.col("tree") < start + batch))
        _grow(x, part, n_labels, params, frac, f"{grown}/state-{start}", f"{grown}/nodes/batch={start}")
    nodes = x.sparkSession.read.schema(NODE_COLUMNS).parquet(f"{grown}/nodes").drop("batch", "level")
    return ForestModel(nodes=nodes, n_trees=params.n_trees, n_labels=n_labels, bag=bag, x=x)


def _named(rows: DataFrame) -> DataFrame:
    """State rows with the name of their node, its smallest sample, and its cells (``mass``)."""
    from pyspark.sql import Window

    here = Window.partitionBy("tree", "parent", "side")
    return rows.withColumn("node", F.min("sample_index").over(here)).withColumn("mass", F.sum("cells").over(here))


STATE_COLUMNS = """tree long, sample_index long, w long, label int, cells long, parent long, side long, node long,
  mass long"""


def _grow(x: DataFrame, roots: DataFrame, n_labels: int, params: ForestParams, frac: float, states: str,
          nodes: str) -> None:
    """Write the nodes of the trees that start with ``roots``: a table a level, then the finished subtrees.

    The state carries each sample's label, joined once, so levels never re-join the labels.
    """
    spark = x.sparkSession
    small = F.col("mass") <= params.local_cells
    rows = roots
    for depth in itertools.count():
        _named(rows).select(*[f.name for f in _schema(spark, STATE_COLUMNS)]).write.parquet(f"{states}/depth={depth}")
        state = spark.read.schema(STATE_COLUMNS).parquet(f"{states}/depth={depth}")
        left = state.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~small).alias("large")).first()
        if not left["large"]:
            break
        large = state.where(~small)
        totals = _node_totals(large, None, n_labels, params.impurity)
        if depth != params.max_depth:
            best = best_splits(x, large, None, totals, n_labels, frac, params.seed + 7919 * (depth + 1),
                               params.impurity, left["large"], left["large"])
            level = totals.join(best, ["tree", "node"], "left")
        else:
            level = totals.select("*", F.lit(None).cast("bigint").alias("variable"),
                                  F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("weighted"))
        gain = F.col("impurity") - F.col("weighted")
        split = F.coalesce(F.col("variable").isNotNull() & (gain > params.min_gain), F.lit(False))
        level.select("tree", F.lit(depth).cast("bigint").alias("depth"), "node", "parent", "side",
                     F.when(split, F.col("variable")).otherwise(F.lit(-1)).cast("bigint").alias("variable"),
                     F.when(split, F.col("threshold")).otherwise(F.lit(0.0)).alias("threshold"),
                     F.col("majority").cast("bigint").alias("majority"),
                     F.when(split, gain).otherwise(F.lit(0.0)).alias("gain"), "impurity", "size",
                     F.lit(-1).cast("bigint").alias("part_depth"), F.lit(-1).cast("bigint").alias("part")
                     ).write.parquet(f"{nodes}/level={depth}")
        splits = spark.read.schema(NODE_COLUMNS).parquet(f"{nodes}/level={depth}").where(F.col("variable") >= 0)
        moving = large.drop("parent", "side", "mass").join(
            _small(splits.select("tree", "node", "variable", "threshold"), left["large"]), ["tree", "node"])
        rows = _route(x, moving, left["large"]).withColumnRenamed("node", "parent")
    rows = spark.read.schema(f"{STATE_COLUMNS}, depth long").parquet(states).where(small)
    rules = subtree.Rules(n_labels, frac, params.seed, params.impurity, params.min_gain, params.max_depth)
    _finish(x, rows, rules).write.parquet(f"{nodes}/level=subtrees")
    discard(spark, states)


def _schema(spark, ddl: str):
    return spark.createDataFrame([], ddl).schema


def _finish(x: DataFrame, rows: DataFrame, rules: subtree.Rules) -> DataFrame:
    """The whole subtrees of the nodes in ``rows``: their cells meet by node, at most ``local_cells`` a group.

    A sample's cells travel as one row, packed once for all nodes that it is in.  There are more
    partitions than usual, since a few large groups may hold all the work and should not meet in one.
    """
    key = ["tree", "depth", "node"]
    parts = 8 * int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = x.join(rows.select("sample_index").distinct(), "sample_index", "left_semi")
    packed = used.groupBy("sample_index").agg(F.collect_list(F.struct(
        F.col("variant_index").cast("bigint").alias("v"), F.col("allele").alias("a"))).alias("e"))
    packed = packed.select("sample_index", F.col("e.v").alias("variables"), F.col("e.a").alias("alleles"))
    brought = rows.select(*key, "sample_index", "w", "label", "parent", "side").join(packed, "sample_index", "left")
    brought = brought.repartition(parts, *key)

    rows_of = [*key, "sample_index", "w", "label", "parent", "side"]

    def run(group: pa.Table) -> pa.Table:
        row = {c: group[c].to_numpy() for c in rows_of}
        order = np.argsort(row["sample_index"])
        sample = row["sample_index"][order]
        weight, label = (row[c][order].astype(np.int64) for c in ("w", "label"))
        tree, depth, node, parent, side = (int(row[c][0]) for c in (*key, "parent", "side"))
        place = np.searchsorted(sample, row["sample_index"])
        cells = np.repeat(place, pc.fill_null(pc.list_value_length(group["variables"]), 0).to_numpy())
        variable, allele = (pc.list_flatten(group[c]).to_numpy() for c in ("variables", "alleles"))
        levels = list(subtree.grow(rules, tree, depth, parent, side, sample, weight, label, cells, variable, allele))
        out = {f: np.concatenate([lv[f] for lv in levels]) for f in subtree.NODE_FIELDS}
        n = len(out["node"])
        out |= {"tree": np.full(n, tree), "part_depth": np.full(n, depth), "part": np.full(n, node)}
        return pa.table({c: pa.array(out[c], type=t) for c, t in arrow.items()})

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {f.name: to_arrow_type(f.dataType) for f in _schema(x.sparkSession, NODE_COLUMNS)}
    return brought.groupBy(*key).applyInArrow(run, NODE_COLUMNS)


def pruned(nodes: DataFrame, max_depth: int) -> DataFrame:
    """The trees cut at a depth: what stood there becomes a leaf, as if they had been grown no deeper."""
    leaf = F.col("depth") == max_depth
    return (nodes.where(F.col("depth") <= max_depth)
            .withColumn("variable", F.when(leaf, F.lit(-1)).otherwise(F.col("variable")).cast("bigint"))
            .withColumn("threshold", F.when(leaf, F.lit(0.0)).otherwise(F.col("threshold")))
            .withColumn("gain", F.when(leaf, F.lit(0.0)).otherwise(F.col("gain"))))


def predict_trees(nodes: DataFrame, x: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """M9: route ``start(tree, sample_index)`` rows down each tree -> ``(tree, sample_index, prediction)``.

    Rows walk the upper levels together, one level a step; per level only its split
    variables are looked up in X (semi-join reduced), never whole vectors.  Rows that
    reach the root of a finished subtree walk the rest of it in one grouped stage.
    """
    nodes = nodes if max_depth is None else pruned(nodes, max_depth)
    arrived = _passed(nodes, x, start)
    leaves = arrived.where((F.col("part") < 0) & (F.col("variable") < 0))
    below_ = _walk_subtrees(nodes.where(F.col("part") >= 0), x, arrived.where(F.col("part") >= 0).select(
        "tree", F.col("depth").alias("part_depth"), F.col("node").alias("part"), "sample_index"))
    return leaves.select("tree", "sample_index", F.col("majority").alias("prediction")).unionByName(below_.drop("max_depth"))


def predict_depths(nodes: DataFrame, x: DataFrame, start: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """The predictions of the trees cut at each of ``depths``, from one walk.

    Rows ``(max_depth, tree, sample_index, prediction)``, for each depth as ``predict_trees`` with it.
    """
    cuts = tuple(sorted(set(depths)))
    nodes = pruned(nodes, cuts[-1])
    passed = _passed(nodes, x, start)
    last = F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: (c == F.col("depth")) | (
        (c > F.col("depth")) & (F.col("variable") < 0)))
    upper = passed.where(F.col("part") < 0).select(F.explode(last).alias("max_depth"), "tree", "sample_index",
                                                   F.col("majority").alias("prediction"))
    below_ = _walk_subtrees(nodes.where(F.col("part") >= 0), x, passed.where(F.col("part") >= 0).select(
        "tree", F.col("depth").alias("part_depth"), F.col("node").alias("part"), "sample_index"), cuts)
    return upper.unionByName(below_)


def _passed(nodes: DataFrame, x: DataFrame, start: DataFrame) -> DataFrame:
    """The upper nodes, down to leaves and roots of finished subtrees, that each row of ``start`` passes: a row each."""
    spark = x.sparkSession
    path = scratch_path(spark, "walk")
    steps = nodes.where((F.col("part") < 0) | ((F.col("depth") == F.col("part_depth")) & (F.col("node") == F.col("part"))))
    steps = pinned(steps.select("tree", "depth", "node", "parent", "side", "variable", "threshold", "majority", "part"),
                   "steps")
    columns = "tree long, sample_index long, node long, variable long, threshold double, majority long, part long"
    state = start.select("tree", "sample_index", F.lit(-1).cast("bigint").alias("parent"),
                         F.lit(0).cast("bigint").alias("side"))
    for depth in itertools.count():
        here = steps.where(F.col("depth") == depth).drop("depth")
        at = state.join(here, ["tree", "parent", "side"]).drop("parent", "side")
        at.write.parquet(f"{path}/depth={depth}")
        at = spark.read.schema(columns).parquet(f"{path}/depth={depth}")
        going = at.where((F.col("part") < 0) & (F.col("variable") >= 0))
        n = going.count()
        if not n:
            break
        state = _route(x, going.drop("majority", "part"), n).withColumnRenamed("node", "parent")
    return spark.read.schema(f"{columns}, depth long").parquet(path)


def _walk_subtrees(nodes: DataFrame, x: DataFrame, rows: DataFrame, cuts: tuple[int | None, ...] = (None,)) -> DataFrame:
    """Predictions of ``rows(tree, part_depth, part, sample_index)``, each group's subtree in one task, for every
    depth of ``cuts`` (``max_depth``) from the subtree's root on.

    A subtree is bounded; many rows at one are dealt over several copies of it.
    """
    key = ["tree", "part_depth", "part"]
    copies = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(WALK_ROWS)).alias("copies"))
    rows = rows.join(copies, key).withColumn("copy", F.pmod(F.xxhash64("sample_index"), F.col("copies"))).drop("copies")
    trees = nodes.join(copies, key).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    trees = trees.select(*key, "copy", "depth", "node", "parent", "side", "variable", "threshold", "majority")
    used = nodes.where(F.col("variable") >= 0).select(*key, F.col("variable").alias("variant_index")).distinct()
    cells = x.join(used.select("variant_index").distinct(), "variant_index", "left_semi")
    needed = cells.join(rows, "sample_index").join(used, [*key, "variant_index"])
    brought = rows.select(*key, "copy", "sample_index", F.lit(None).cast("long").alias("variable"),
                          F.lit(None).cast("double").alias("allele")).unionByName(
        needed.select(*key, "copy", "sample_index", F.col("variant_index").cast("bigint").alias("variable"), "allele"))

    def run(tree: pa.Table, part: pa.Table) -> pa.Table:
        if not len(part) or not len(tree):
            return pa.table({c: pa.array([], type=pa.int64()) for c in ("max_depth", "tree", "sample_index", "prediction")})
        samples, place = np.unique(part["sample_index"].to_numpy(), return_inverse=True)
        cell = part["variable"].is_valid().to_numpy()
        nodes_of = {c: tree[c].to_numpy() for c in ("depth", "node", "parent", "side", "variable", "threshold", "majority")}
        found = subtree.walk(nodes_of, len(samples), place[cell], part["variable"].drop_null().to_numpy(),
                             part["allele"].filter(part["variable"].is_valid()).to_numpy(), cuts)
        number, n = part["tree"][0].as_py(), len(samples)
        cut = [c for c in found for _ in range(n)]
        sample, prediction = np.tile(samples, len(found)), np.concatenate([*found.values(), np.zeros(0, dtype=np.int64)])
        return pa.table({"max_depth": pa.array(cut, type=pa.int64()),
                         "tree": pa.array([number] * len(cut), type=pa.int64()),
                         "sample_index": pa.array(sample, type=pa.int64()),
                         "prediction": pa.array(prediction, type=pa.int64())})

    group = [*key, "copy"]
    return trees.groupBy(*group).cogroup(brought.groupBy(*group)).applyInArrow(
        run, "max_depth long, tree long, sample_index long, prediction long")


def forest_predict(model: ForestModel, x: DataFrame, samples: DataFrame) -> DataFrame:
    """Majority vote of all trees (ties -> largest label) per sample."""
    from allelo.operators.metrics import majority_vote

    start = samples.select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(model.n_trees - 1))).alias("tree"))
    votes = predict_trees(model.nodes, x, start)
    return majority_vote(votes, ["sample_index"], "prediction")


def out_of_bag(model: ForestModel, x: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Out-of-bag votes and error.

    Returns ``(per_tree, summary)``.  ``per_tree.error`` is the running error
    after each tree over samples holding at least one vote; ``error_all`` is
    the original definition (all samples, unvoted ones predicted as the
    highest label).  ``summary`` has the final OOB error, the mean of the
    running errors and the original forest error (mean of ``error_all``).
    """
    from pyspark.sql import Window

    trees = labels.select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(model.n_trees - 1))).alias("tree"))
    oob = trees.join(model.bag.select("tree", "sample_index"), ["tree", "sample_index"], "left_anti")
    votes = predict_trees(model.nodes, x, oob)
    # running vote counts: votes of trees <= t for each (t, sample, label)
    per = votes.groupBy("tree", "sample_index", "prediction").agg(F.count(F.lit(1)).alias("v"))
    tt = per.select("sample_index", "prediction", "tree", "v")
    w = Window.partitionBy("sample_index", "prediction").orderBy("tree").rowsBetween(Window.unboundedPreceding, 0)
    cum = tt.withColumn("cv", F.sum("v").over(w))
    # carry each (sample, label) running count forward to every later tree
    steps = cum.withColumn("upto", F.coalesce(F.lead("tree").over(
        Window.partitionBy("sample_index", "prediction").orderBy("tree")) - 1, F.lit(model.n_trees - 1)))
    expanded = steps.select("sample_index", "prediction", "cv",
                            F.explode(F.sequence(F.col("tree"), F.col("upto"))).alias("t"))
    best = expanded.groupBy("t", "sample_index").agg(
        F.max(F.struct("cv", "prediction")).alias("b"))
    scored = best.join(labels, "sample_index").select(
        "t", (F.col("b.prediction") != F.col("label")).cast("double").alias("wrong"))
    voted = scored.groupBy(F.col("t").alias("tree")).agg(F.sum("wrong").alias("wrong"),
                                                          F.count(F.lit(1)).alias("n_voted"))
    # original definition: every sample counts after every tree; a sample with no vote yet
    # is predicted as the highest label.  Unvoted samples at tree t are those whose first
    # vote comes after t (or never): one row per (sample, tree before its first vote).
    n_total = labels.count()
    first = votes.groupBy("sample_index").agg(F.min("tree").alias("first"))
    unvoted = (labels.join(first, "sample_index", "left")
               .select("label", F.coalesce("first", F.lit(model.n_trees)).alias("first"))
               .where(F.col("first") > 0)
               .select("label", F.explode(F.sequence(F.lit(0), F.col("first") - 1)).alias("tree"))
               .groupBy("tree").agg(F.sum((F.col("label") != model.n_labels - 1).cast("bigint")).alias("u_wrong")))
    per_tree = (voted.join(unvoted, "tree", "full").fillna(0, ["wrong", "n_voted", "u_wrong"])
                .select("tree", F.when(F.col("n_voted") > 0, F.col("wrong") / F.col("n_voted")).alias("error"),
                        "n_voted",
                        ((F.col("wrong") + F.col("u_wrong")) / F.lit(float(n_total))).alias("error_all")))
    summary = per_tree.agg(F.max_by("error", "tree").alias("oob_error"),
                           F.avg("error").alias("mean_running_error"),
                           F.avg("error_all").alias("original_forest_error"))
    return per_tree, summary


def importance(nodes: DataFrame, n_trees: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``sum over trees of (n G - n_l G_l - n_r G_r) / n_root``, divided by the tree count.

    ``by=("tree",)`` gives the importances of every tree in one aggregate.
    """
    children = nodes.where(F.col("depth") > 0).groupBy(
        "tree", (F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(
        F.sum(F.col("size") * F.col("impurity")).alias("below"))
    root = nodes.where(F.col("depth") == 0).select("tree", F.col("size").alias("root_size"))
    j = nodes.where(F.col("variable") >= 0).join(children, ["tree", "depth", "node"]).join(root, "tree")
    contrib = (F.col("size") * F.col("impurity") - F.col("below")) / F.col("root_size")
    return j.groupBy(*by, "variable").agg((F.sum(contrib) / F.lit(float(n_trees))).alias("importance"),
                                     F.count(F.lit(1)).alias("n_splits"))


def importance_stability(importances: DataFrame, top_n: int) -> DataFrame:
    """How often each variable is in a model's top ``top_n`` across ``model_id``s."""
    from pyspark.sql import Window

    w = Window.partitionBy("model_id").orderBy(F.round("importance", 9).desc(), F.col("variable"))
    top = importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return top.groupBy("variable").agg(F.count(F.lit(1)).alias("n_models"),
                                       F.sum("importance").alias("total_importance"))
