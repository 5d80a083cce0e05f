"""Invariants of the randomised (hash-seeded) operators and algorithm properties."""

import pytest
from pyspark.sql import functions as F

from allelo.operators import forest, kmeans, sampling
from allelo.operators.indexing import dense_index
from tests.conftest import SF_SMALL


def test_dense_index_is_a_permutation(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 10007).alias("k"))
    idx = dense_index(df, ["k"], "i")
    rows = idx.orderBy("k").collect()
    assert [r.i for r in rows] == list(range(5000))


def test_subsample_and_folds(spark):
    s = spark.range(10).select(F.col("id").alias("sid"))
    sub = sampling.subsample(s, "sid", size=5, seed=1).collect()
    assert len({r.sid for r in sub}) == 5 and all(0 <= r.sid < 10 for r in sub)
    f = sampling.folds(s, "sid", 3, seed=2).collect()
    sizes = {}
    for r in f:
        sizes[r.fold] = sizes.get(r.fold, 0) + 1
    assert sorted(sizes.values()) == [3, 3, 4]
    assert sorted(r.sid for r in f) == list(range(10))


def test_split_fractions_and_stability(spark):
    s = spark.range(20000).select(F.col("id").alias("k"))
    a = sampling.split_hash(s, "k", [0.8, 0.2], seed=4)
    frac = a.where(F.col("split") == 0).count() / 20000
    assert 0.78 < frac < 0.82
    b = sampling.split_hash(s.repartition(7), "k", [0.8, 0.2], seed=4)
    assert a.exceptAll(b).count() == 0


def test_bootstrap_weights_sum_to_n(spark):
    s = spark.range(50).select(F.col("id").alias("sample_index"))
    bag = forest.bootstrap(s, 50, 4, seed=3)
    sums = {r.tree: r.t for r in bag.groupBy("tree").agg(F.sum("w").alias("t")).collect()}
    assert sums == {0: 50, 1: 50, 2: 50, 3: 50}


def _cells(spark):
    from allelo.plans.common import indexed
    long, subjects, variants, x = indexed(spark, SF_SMALL, "planted")
    return subjects, x


def test_kmeans_cost_non_increasing(spark):
    from allelo.operators import metrics
    subjects, x = _cells(spark)
    k = 3
    costs = []
    for it in (0, 1, 2):
        res = kmeans.fit(x, subjects, k, it)
        a = res.assignment.select("subject_index", "cluster")
        costs.append(metrics.wssse(kmeans.prepare(x), a, kmeans.centres_to_long(res.centres)).first().wssse)
    assert costs[1] <= costs[0] + 1e-9 and costs[2] <= costs[1] + 1e-9


def test_forest_invariants(spark):
    subjects, x = _cells(spark)
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    labels = subjects.select(F.col("subject_index").alias("sample_index"),
                             (F.col("subject_index") % 3).cast("int").alias("label"))
    model = forest.fit(cells, labels, 3, forest.ForestParams(n_trees=3, mtry_fraction=0.5, max_depth=4, seed=5))
    nodes = model.nodes.collect()
    assert all(r.gain >= 0 for r in nodes)
    below = {(r.tree, r.depth, r.parent, r.side): r for r in nodes}
    for r in nodes:
        if r.variable >= 0:   # split nodes have both children whose sizes add up
            assert sum(below[r.tree, r.depth + 1, r.node, side].size for side in (0, 1)) == r.size
    n = labels.count()
    trees = labels.select("sample_index", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("tree"))
    oob = trees.join(model.bag, ["tree", "sample_index"], "left_anti")
    assert oob.join(model.bag, ["tree", "sample_index"]).count() == 0
    assert oob.count() + model.bag.count() == 3 * n
    per_tree, summary = forest.out_of_bag(model, forest.prepare_cells(cells), labels)
    s = summary.first()
    assert 0.0 <= s.oob_error <= 1.0


def test_vcf_stream_ingest(spark):
    import tempfile

    from allelo.plans.common import indexed
    from allelo.sources import vcf as v
    from allelo.streaming.ingest import vcf_stream

    long, subjects, variants, x = indexed(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="allelo-stream-")
    paths = v.write_vcf(x.select("subject_index", "variant_key", "allele"), subjects, subjects.count(), root + "/vcf")
    q = vcf_stream(spark, paths[1], paths[0], root + "/out", root + "/ckpt")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(root + "/out").count()
    assert got == long.count()


def test_vcf_header_mismatch_raises(spark):
    import tempfile

    import pytest

    from allelo.sources import vcf as v

    root = tempfile.mkdtemp(prefix="allelo-vcf-")
    a = ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2", "1\t100\t.\tA\tC\t.\tPASS\t.\tGT\t0|1\t1|1"]
    b = ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS2\tS1", "1\t200\t.\tA\tC\t.\tPASS\t.\tGT\t0|0\t1/1"]
    for name, lines in (("a.vcf", a), ("b.vcf", b)):
        with open(f"{root}/{name}", "w") as fh:
            fh.write("\n".join(lines) + "\n")
    with pytest.raises(ValueError):
        v.read_vcf(spark, f"{root}/a.vcf,{root}/b.vcf")
    one = v.read_vcf(spark, f"{root}/a.vcf").cells.collect()
    assert sorted((r.subject_id, r.allele) for r in one) == [("S1", 1.0), ("S2", 2.0)]


def test_parquet_filter_is_pushed(spark):
    from allelo.plans.q_core import q_locus_range_parquet
    from tests.conftest import SF_SMALL as sf

    df = q_locus_range_parquet(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(variant_key), GreaterThanOrEqual(variant_key,200)" in plan


def test_vcf_gzip_by_extension(spark):
    import gzip
    import tempfile

    from allelo.sources import vcf as v

    root = tempfile.mkdtemp(prefix="allelo-vcfgz-")
    lines = ["##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC",
             "2\t50\t.\tG\tT\t.\tPASS\t.\tGT\t1|1\t0|0\t0/1", "2\t70\t.\tG\tA\t.\tPASS\t.\tGT:DP\t./.:3\t1|0:9\t0|0:1"]
    with gzip.open(f"{root}/chr2.vcf.gz", "wt") as fh:
        fh.write("\n".join(lines) + "\n")
    cells = v.read_vcf(spark, f"{root}/chr2.vcf.gz").cells
    got = sorted((r.subject_id, r.pos, r.allele) for r in cells.collect())
    assert got == [("A", 50, 2.0), ("B", 70, 1.0), ("C", 50, 1.0)]


def test_forest_batches_equal_single_fit(spark):
    subjects, x = _cells(spark)
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    labels = subjects.select(F.col("subject_index").alias("sample_index"),
                             (F.col("subject_index") % 2).cast("int").alias("label"))
    p = forest.ForestParams(n_trees=4, mtry_fraction=0.5, max_depth=3, seed=9)
    one = forest.fit(cells, labels, 2, p).nodes
    two = forest.fit(cells, labels, 2, p, trees_per_batch=2).nodes
    cols = ["tree", "depth", "node", "variable", "threshold", "majority", "size"]
    assert one.select(cols).exceptAll(two.select(cols)).count() == 0
    assert two.select(cols).exceptAll(one.select(cols)).count() == 0


def test_oob_original_definition_bounds(spark):
    subjects, x = _cells(spark)
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    labels = subjects.select(F.col("subject_index").alias("sample_index"),
                             (F.col("subject_index") % 3).cast("int").alias("label"))
    model = forest.fit(cells, labels, 3, forest.ForestParams(n_trees=3, mtry_fraction=0.5, max_depth=3, seed=2))
    per_tree, summary = forest.out_of_bag(model, forest.prepare_cells(cells), labels)
    rows = per_tree.collect()
    assert sorted(r.tree for r in rows) == [0, 1, 2]
    assert all(0.0 <= r.error_all <= 1.0 for r in rows)
    s = summary.first()
    assert 0.0 <= s.original_forest_error <= 1.0


@pytest.mark.parametrize(("kind", "max_depth"), [("gini", None), ("entropy", None), ("gini", 3)])
def test_subtrees_of_one_task_equal_levels(spark, kind, max_depth):
    subjects, x = _cells(spark)
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    labels = subjects.select(F.col("subject_index").alias("sample_index"),
                             (F.col("subject_index") * 7 % 3).cast("int").alias("label"))
    got = []
    for bound in (0, 40, 10**9):  # levels only, both, subtrees only
        p = forest.ForestParams(n_trees=3, mtry_fraction=0.5, seed=4, impurity=kind, max_depth=max_depth, local_cells=bound)
        model = forest.fit(cells, labels, 3, p)
        votes = forest.predict_trees(model.nodes, model.x, model.bag.select("tree", "sample_index"))
        got.append((sorted((r.tree, r.depth, r.node, r.parent, r.side, r.variable, r.threshold, r.majority, r.size,
                            round(r.gain, 9), round(r.impurity, 9)) for r in model.nodes.collect()),
                    sorted(map(tuple, votes.collect()))))
    assert got[0] == got[1] == got[2]


def test_a_chain_deeper_than_a_path_number(spark):
    # variable v is carried by sample v alone, and labels alternate: every split peels off one sample
    n = 150
    cells = spark.range(n).select(F.col("id").alias("sample_index"), F.col("id").alias("variant_index"),
                                  F.lit(1.0).alias("allele"))
    labels = spark.range(n).select(F.col("id").alias("sample_index"), (F.col("id") % 2).cast("int").alias("label"))
    p = forest.ForestParams(n_trees=1, mtry_fraction=1.0, bootstrap=False, local_cells=n - 2)
    model = forest.fit(cells, labels, 2, p)
    assert model.nodes.agg(F.max("depth")).first()[0] > 61
    votes = forest.predict_trees(model.nodes, model.x, model.bag.select("tree", "sample_index"))
    assert votes.join(labels, "sample_index").where("prediction = label").count() == n
