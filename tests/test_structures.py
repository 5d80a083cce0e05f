"""Streamed Gram products, sampled cosines, projector, evaluations in one growth, saved models, one VCF scan."""

import itertools
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelo.operators import forest, kmeans, model_store, validation
from allelo.operators import matrix as mx
from allelo.operators.projector import Projector


def _random_cells(spark, subjects=37, variants=200, seed=3):
    rng = np.random.default_rng(seed)
    dense = rng.choice([0, 0, 0, 1, 2], size=(subjects, variants)).astype(float)
    dense[5] = 0  # an all-zero column
    rows = [(int(i), int(v) * 7, float(dense[i, v])) for i, v in zip(*np.nonzero(dense), strict=True)]
    return dense, spark.createDataFrame(rows, "subject_index long, variant_index long, allele double")


@pytest.mark.parametrize(("tile", "batch", "chunk"), [(64, 10_000, 1024), (8, 50, 3), (5, 7, 1)])
def test_gram_is_streamed_whatever_the_batches(spark, monkeypatch, tile, batch, chunk):
    monkeypatch.setattr(mx, "CHUNK", chunk)
    dense, cells = _random_cells(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.i, r.j): r.g for r in mx.gram(cells, len(dense), tile=tile).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = dense @ dense.T
    assert got == {(i, j): want[i, j] for i, j in itertools.combinations_with_replacement(range(len(dense)), 2) if want[i, j]}


def test_gram_copies_and_multiplies_only_what_meets(spark):
    # rare variants lie in few tiles, one is carried by everyone: single products and dense blocks
    rng = np.random.default_rng(4)
    n, tile = 200, 32
    dense = np.zeros((n, 120))
    for v in range(119):
        dense[(v + rng.choice(6, 3, replace=False)) % n, v] = rng.integers(1, 3, 3)
    dense[:, 119] = 1.0
    dense[40:80] = 0
    rows = [(int(i), int(v), float(dense[i, v])) for i, v in zip(*np.nonzero(dense), strict=True)]
    g = mx.gram(spark.createDataFrame(rows, "subject_index long, variant_index long, allele double"), n, tile=tile, partitions=2)
    want = dense @ dense.T
    assert {(r.i, r.j): r.g for r in g.collect()} == {(i, j): want[i, j] for i, j in zip(*np.nonzero(np.triu(want)), strict=True)}

    sent = []

    def counted(batches):
        for batch in batches:
            sent.append(batch.num_rows)
            yield batch

    import pyarrow as pa

    pair = [np.repeat(np.int32(0), 6), np.repeat(np.int32(1), 6), np.arange(6) // 2, np.tile([3, 1500], 3), np.arange(1.0, 7.0)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in pair], names=["ti", "tj", "variant_index", "subject_index", "allele"])
    out = list(counted(mx._products(1024)(iter([batch]))))
    assert sent == [1]
    # one row with one entry, not a row of the whole tile
    assert out[0].to_pydict() == {"ti": [0], "tj": [1], "r": [3], "cs": [[476]], "g": [[2.0 + 12.0 + 30.0]]}


def test_exact_cosines_use_one_product(spark):
    dense, cells = _random_cells(spark)
    df = mx.cosine_similarity(cells, len(dense))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1
    length = np.sqrt((dense * dense).sum(axis=1))
    for r in df.collect():
        assert r.cosine == pytest.approx(dense[r.i] @ dense[r.j] / length[r.i] / length[r.j])


def test_sampled_cosines_are_unbiased_and_exact_for_short_columns(spark):
    dense, cells = _random_cells(spark, subjects=12, variants=300)
    n = len(dense)
    exact = {(r.i, r.j): r.cosine for r in mx.cosine_similarity(cells, n).where("i < j").collect()}
    whole = {(r.i, r.j): r.cosine for r in mx.sampled_cosine(cells, n, threshold=0.001).collect()}
    assert whole == pytest.approx(exact)  # every column is shorter than the scale: nothing is left out
    runs = [{(r.i, r.j): r.cosine for r in mx.sampled_cosine(cells, n, threshold=0.4, seed=s).collect()} for s in range(12)]
    some = [abs(run.get(p, 0.0) - c) for run in runs for p, c in exact.items()]
    assert max(some) > 0  # sampled
    for p, c in exact.items():
        assert np.mean([run.get(p, 0.0) for run in runs]) == pytest.approx(c, abs=0.12)


def test_projector_and_its_inverse_cover_all(spark):
    every = spark.range(10).select(F.col("id").alias("sample_index"))
    chosen = spark.createDataFrame([(2,), (7,), (7,), (99,), (None,)], "sample_index long")
    keep, drop = Projector(every, chosen).pair
    labels = every.withColumn("label", F.col("sample_index") * 10)
    assert sorted(map(tuple, keep.project(labels).collect())) == [(0, 20), (1, 70)]
    assert sorted(map(tuple, drop.project(labels).collect())) == list(enumerate([0, 10, 30, 40, 50, 60, 80, 90]))
    assert sorted(drop.inverted.project(labels).collect()) == sorted(keep.project(labels).collect())
    cells = labels.crossJoin(spark.range(3).withColumnRenamed("id", "variant_index"))
    assert keep.project(cells).count() + drop.project(cells).count() == 30
    assert Projector(every, chosen.where("false")).project(labels).count() == 0


def _labelled(spark):
    dense, cells = _random_cells(spark, subjects=30, variants=40, seed=9)
    cells = cells.withColumnRenamed("subject_index", "sample_index")
    labels = spark.range(30).select(F.col("id").alias("sample_index"), (F.col("id") % 3).cast("int").alias("label"))
    return cells, labels


def test_folds_grown_together_equal_separate_fits(spark):
    cells, labels = _labelled(spark)
    parts = validation.fold_parts(labels.select("sample_index", (F.col("sample_index") % 4).alias("fold")), 4).checkpoint()
    params = forest.ForestParams(n_trees=2, mtry_fraction=0.5, seed=6)
    model = validation.fit_parts(cells, labels, parts, 4, 3, params)
    bag = validation.part_bags(parts, 30, 4, params)
    columns = ["tree", "depth", "node", "parent", "side", "variable", "threshold", "majority", "size"]
    together = sorted(map(tuple, model.nodes.select(*columns).collect()))
    for part in range(4):
        trees = (2 * part, 2 * part + 1)
        one = forest.fit(cells, labels, 3, forest.ForestParams(n_trees=8, mtry_fraction=0.5, seed=6),
                         bag=bag.where(F.col("tree").isin(*trees)))
        assert sorted(map(tuple, one.nodes.select(*columns).collect())) == [r for r in together if r[0] in trees]
        inside = bag.where(F.col("tree").isin(*trees)).select("sample_index").distinct()
        assert inside.where(F.col("sample_index") % 4 == part).count() == 0
    held = validation.held_out(model, labels, parts, 2)
    assert sorted(r.sample_index for r in held.collect()) == list(range(30))


def test_a_tree_cut_at_a_depth_is_one_grown_no_deeper(spark):
    cells, labels = _labelled(spark)
    bag = labels.select(F.lit(0).cast("long").alias("tree"), "sample_index", F.lit(1).cast("long").alias("w"))
    whole, shallow = (forest.fit(cells, labels, 3, forest.ForestParams(mtry_fraction=1.0, bootstrap=False, max_depth=d), bag=bag)
                      for d in (None, 2))
    columns = ["tree", "depth", "node", "variable", "threshold", "majority", "size"]
    assert sorted(map(tuple, forest.pruned(whole.nodes, 2).select(*columns).collect())) \
        == sorted(map(tuple, shallow.nodes.select(*columns).collect()))


@pytest.mark.parametrize("local", [0, 400])
def test_one_walk_gives_the_votes_of_every_depth(spark, local):
    cells, labels = _labelled(spark)
    parts = validation.fold_parts(labels.select("sample_index", (F.col("sample_index") % 3).alias("fold")), 3).checkpoint()
    params = forest.ForestParams(n_trees=2, mtry_fraction=0.5, seed=6, max_depth=4, local_cells=local)
    model = validation.fit_parts(cells, labels, parts, 3, 3, params, forest.prepare_cells(cells))
    together = validation.held_out_depths(model, labels, parts, 2, (1, 2, 4)).collect()
    columns = ["part", "sample_index", "label", "prediction"]
    for depth in (1, 2, 4):
        alone = validation.held_out(model, labels, parts, 2, depth).select(*columns)
        assert sorted(tuple(r[c] for c in columns) for r in together if r.max_depth == depth) \
            == sorted(map(tuple, alone.collect()))


def test_saved_models_come_back_and_others_are_refused(spark):
    cells, labels = _labelled(spark)
    params = forest.ForestParams(n_trees=3, mtry_fraction=0.5, seed=2)
    model = forest.fit(cells, labels, 3, params)
    path = tempfile.mkdtemp(prefix="allelo-model-")
    model_store.save_forest(model, params, f"{path}/f", labels)
    back, same = model_store.load_forest(spark, f"{path}/f", model.x)
    assert same == params and back.n_labels == 3 and back.n_trees == 3
    votes = [sorted(map(tuple, forest.forest_predict(m, model.x, labels).collect())) for m in (model, back)]
    assert votes[0] == votes[1]
    with pytest.raises(ValueError, match="not a centres"):
        model_store.load_centres(spark, f"{path}/f")
    spark.createDataFrame([('{"version": 0, "kind": "forest"}',)], "value string").write.text(f"{path}/old/meta")
    with pytest.raises(ValueError, match="version 0"):
        model_store.load_forest(spark, f"{path}/old")
    back.nodes.drop("gain").write.mode("overwrite").parquet(f"{path}/g")
    os.rename(f"{path}/f/nodes", f"{path}/kept")
    os.rename(f"{path}/g", f"{path}/f/nodes")
    with pytest.raises(ValueError, match="columns"):
        model_store.load_forest(spark, f"{path}/f")


def test_kmeans_stops_by_its_tolerance_or_its_rounds(spark):
    dense, cells = _random_cells(spark, subjects=30, variants=60)
    subjects = spark.range(30).withColumnRenamed("id", "subject_index")
    x = np.asarray(dense)
    centres, rounds = x[:4].copy(), 0
    while True:
        near = np.round(((x[:, None] - centres) ** 2).sum(axis=2), 9).argmin(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else np.zeros(x.shape[1]) for j in range(4)])
        moved, centres, rounds = np.sqrt(((new - centres) ** 2).sum(axis=1)).max(), new, rounds + 1
        if moved <= 1e-3:
            break
    res = kmeans.fit(cells, subjects, 4)
    assert res.iterations == rounds > 1 and res.shift <= 1e-3
    near = np.round(((x[:, None] - centres) ** 2).sum(axis=2), 9).argmin(axis=1)
    assert {r.subject_index: r.cluster for r in res.assignment.collect()} == dict(enumerate(near.tolist()))
    again = kmeans.assign(res.x, res.centres, subjects, 4, subjects.count())  # on the cells that the fit has partitioned
    assert sorted((r.subject_index, r.cluster) for r in again.collect()) \
        == sorted((r.subject_index, r.cluster) for r in res.assignment.collect())
    assert kmeans.fit(cells, subjects, 4, iterations=1).iterations == 1
    assert kmeans.fit(cells, subjects, 4, iterations=rounds + 2, tol=-1.0).iterations == rounds + 2
    with pytest.raises(ValueError):
        kmeans.fit(cells, subjects, 4, tol=-1.0)


def test_vcf_text_is_scanned_once(spark, monkeypatch):
    from allelo.sources import vcf as v

    monkeypatch.setattr(v, "HEAD_LINES", 2)
    root = tempfile.mkdtemp(prefix="allelo-vcf1-")
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"
    files = {"a.vcf": ["##x"] * 30 + [head, "1\t100\t.\tA\tC\t.\tPASS\t.\tGT\t0|1\t1|1"],
             "b.vcf": ["2\t100\t.\tA\tC\t.\tPASS\t.\tGT\t0|0\t0|1"],  # a body shard without a header
             "c.vcf": ["##only comments"]}
    for name, lines in files.items():
        with open(f"{root}/{name}", "w") as fh:
            fh.write("\n".join(lines) + "\n")
    data = v.read_vcf(spark, [f"{root}/{f}" for f in files])
    plan = data.cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    assert sorted((r.subject_id, r.contig, r.allele) for r in data.cells.collect()) == [
        ("S1", "1", 1.0), ("S2", "1", 2.0), ("S2", "2", 1.0)]
    with pytest.raises(ValueError, match="found 0"):
        v.read_vcf(spark, f"{root}/b.vcf")


def test_importances_from_saved_nodes_equal_the_models(spark):
    from allelo.plans import tall

    cells, labels = _labelled(spark)
    vectors, d, feats = tall.tall_vectors(cells, labels)
    data = labels.join(vectors, "sample_index")
    model = tall.rf_classifier(data, n_trees=5, max_depth=4, seed=3).stages[-1]
    got = tall.saved_importances(model, tempfile.mkdtemp(prefix="allelo-imp-"), feats)
    want = model.featureImportances.toArray()
    assert {r.feature: r.importance for r in got.collect()} == pytest.approx(dict(enumerate(want.tolist())))


def test_vcf_calls_as_runs_equal_a_plain_parser(spark):
    from allelo.sources import vcf as v

    rng = np.random.default_rng(8)
    kinds = ["0|0"] * 9 + ["0/0", "0|0:27", "0/0:3:x", "0|1", "1/1:9", "./.", "0", "", "0|0|1", "0|01", "10|0", "1|2"]
    rows = [["0|0"] * 200, ["0|0"] * 64 + ["0|0:5"] + ["0|0"] * 65 + ["1|1"], ["0|1"] + ["0|0"] * 129, ["0|0"] * 63 + ["0|01"], []]
    rows += [list(np.repeat(rng.choice(kinds, 30), rng.integers(1, 90, 30))) for _ in range(12)]
    fixed = lambda i: [str(i % 3), str(i * 100), "0|0", "A", "C", ".", "PASS", ".", "0|0" if i == 2 else "GT"]
    lines = spark.createDataFrame([("\t".join(fixed(i) + r),) for i, r in enumerate(rows)] + [("#c",), ("",)], "value string")
    want = [(str(i % 3), i * 100, k, gt) for i, r in enumerate(rows) for k, gt in enumerate(r)]
    got = [(r.contig, r.pos, r.sample_pos, r.gt) for r in v.parse_cells(lines, keep_zero=True).collect()]
    assert sorted(got) == sorted(want)
    dose = lambda gt: (lambda c: int(c[0]) + int(c[2]) if len(c) == 3 and c[0].isdigit() and c[1] in "|/" and c[2].isdigit() else 0)(
        gt.split(":")[0])
    called = [(r.pos, r.sample_pos, r.allele) for r in v.parse_cells(lines).collect()]
    assert sorted(called) == sorted((p, k, float(dose(gt))) for _, p, k, gt in want if dose(gt))
    assert v.call_runs(lines, keep_zero=True).where("pos = 0").count() == 1  # 200 calls, one row
    odd = spark.createDataFrame([("\t".join(["1", "A"] + ["."] * 7 + ["0|1"]),)], "value string")
    assert [r.allele for r in v.parse_cells(odd).select("allele").collect()] == [1.0]  # nobody asked for the position


def test_dense_text_is_written_compressed(spark, monkeypatch):
    """The text of a cohort is samples x variants: what lies on disk must follow the calls instead."""
    import glob

    from allelo.plans import q_core, q_io

    root = tempfile.mkdtemp(prefix="allelo-dense-")
    for module in (q_core, q_io):
        monkeypatch.setattr(module, "scratch_path", lambda s, name: f"{root}/{name}")
    sf = "/root/testdata/sf0.01"
    cells = q_core.q_vcf_lines(spark, sf).count()
    q_io.q_wide_export(spark, sf).count()
    for folder, text in (("vcf/body", 4 * 100 * 2000), ("export/rows", 2 * 100 * 2000)):
        files = glob.glob(f"{root}/{folder}/part-*")
        assert files and all(f.endswith(".gz") for f in files)
        assert sum(map(os.path.getsize, files)) < text / 3
    assert cells > 0


@pytest.mark.parametrize("fraction", [0.4, 1.0])
def test_large_nodes_that_keep_their_counts_grow_the_same_subtree(monkeypatch, fraction):
    from allelo.operators import subtree

    rng = np.random.default_rng(12)
    samples, variables, carriers = 120, 300, 6   # few carriers a variable: a tree like a chain
    sample = np.concatenate([rng.choice(samples, carriers, replace=False) for _ in range(variables)])
    variable, allele = np.repeat(np.arange(variables) * 7, carriers), rng.integers(1, 4, variables * carriers).astype(float)
    weight, label, ids = rng.integers(0, 3, samples), rng.integers(0, 4, samples), np.arange(samples) * 3
    counted = []
    first = subtree.Counts.__init__
    monkeypatch.setattr(subtree.Counts, "__init__", lambda self, pair, *a: (counted.append(len(pair)), first(self, pair, *a))[1])
    grown = []
    for large in (10**9, 1, 200):
        monkeypatch.setattr(subtree, "LARGE", large)
        rules = subtree.Rules(4, fraction, 3, "gini", 1e-12, None)
        levels = subtree.grow(rules, 0, 0, -1, 0, ids, weight, label, sample, variable, allele)
        grown.append([[lv[f].tolist() for f in subtree.NODE_FIELDS] for lv in levels])
    assert grown[0] == grown[1] == grown[2] and len(grown[0]) > 10
    # with counts kept, a level counts the cells that leave a large node, not those that stay
    assert sum(counted) < len(sample) * len(grown[0])


def test_equal_right_sides_are_scored_once_and_follow_what_leaves():
    from allelo.operators import subtree

    rng = np.random.default_rng(5)
    samples, variables, carriers = 90, 2000, 3
    sample = np.concatenate([rng.choice(samples, carriers, replace=False) for _ in range(variables)])
    variable, allele = np.repeat(np.arange(variables) * 3, carriers), rng.integers(1, 3, variables * carriers).astype(float)
    label, weight = rng.integers(0, 3, samples), rng.integers(1, 3, samples)
    cells = subtree._Cells(sample, variable, allele, samples)

    def counts(of):
        at = np.flatnonzero(np.isin(cells.sample, of))
        s = cells.sample[at]
        return subtree.Counts(cells.pair[at], label[s], weight[s], 3, cells.pair_variable)

    node, here = counts(np.arange(samples)), np.arange(samples)
    for depth, gone in enumerate((rng.choice(samples, 12, replace=False), np.arange(samples // 2), np.arange(60, samples))):
        for fraction in (1.0, 0.2, 0.001):
            rules = subtree.Rules(3, fraction, 3, "gini", 1e-12, None)
            totals = subtree.sums(np.zeros(len(here), dtype=np.int64), label[here], weight[here], 1, 3)
            best = [c.best(cells.pair_allele, totals[0], float(subtree.impurity(totals, "gini")[0]), rules, depth, 2, 7)
                    for c in (node, counts(here))]
            assert best[0] == best[1] and (best[0] is not None or fraction < 0.01)
        assert (node.members > 0).sum() < len(node.pair) / 4
        gone = np.intersect1d(gone, here)
        node.take_off(counts(gone))
        here = np.setdiff1d(here, gone)


@pytest.mark.parametrize("carriers", [4, 60])
def test_samples_walk_a_subtree_together(carriers):
    from allelo.operators import subtree

    rng = np.random.default_rng(8)
    samples, variables = 120, 150
    sample = np.concatenate([rng.choice(samples, carriers, replace=False) for _ in range(variables)])
    variable, allele = np.repeat(np.arange(variables), carriers), rng.integers(1, 4, variables * carriers).astype(float)
    rules = subtree.Rules(4, 0.5, 3, "gini", 1e-12, None)
    levels = list(subtree.grow(rules, 1, 2, 5, 1, np.arange(samples), np.ones(samples, dtype=np.int64),
                               rng.integers(0, 4, samples), sample, variable, allele))
    nodes = {f: np.concatenate([lv[f] for lv in levels]) for f in subtree.NODE_FIELDS}
    held = {(s, v): a for s, v, a in zip(sample.tolist(), variable.tolist(), allele.tolist(), strict=True)}
    child = {(int(d), int(p), int(s)): i for i, (d, p, s) in enumerate(zip(nodes["depth"], nodes["parent"], nodes["side"], strict=True))}

    def plain(s, cut):
        i = child[2, 5, 1]
        while nodes["variable"][i] >= 0 and nodes["depth"][i] != cut:
            side = int(held.get((s, int(nodes["variable"][i])), 0.0) > nodes["threshold"][i])
            i = child[int(nodes["depth"][i]) + 1, int(nodes["node"][i]), side]
        return nodes["majority"][i]

    found = subtree.walk(nodes, samples, sample, variable, allele, (1, 2, 4, None))
    assert set(found) == {2, 4, None} and len(levels) > 5
    for cut, got in found.items():
        assert got.tolist() == [plain(s, cut) for s in range(samples)]
