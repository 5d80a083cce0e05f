"""Golden values taken from the original tool's unit tests (see FIXTURES.md part A)."""

import pytest
from pyspark.sql import functions as F

from allelo.functions.genotype import bmi, dosage, dosage_sqrt, round_half_up, sex_code
from allelo.operators import forest, metrics
from allelo.sources.panel import filter_groups


def test_dosage_golden(spark):
    calls = ["0|0", "0/0", "0|1", "0/1", "1|1", "1/1", ".|.", "./.", "0/1:27:0:1"]
    expected = [0, 0, 1, 1, 2, 2, 0, 0, 1]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "i int, gt string")
    got = [r.d for r in df.select("i", dosage("gt").alias("d")).orderBy("i").collect()]
    assert got == expected


def test_dosage_edge_cases(spark):
    cases = {"1|2": 3.0, "0": 0.0, "10|1": 0.0, ".|1": 0.0, "1/1:33": 2.0, "": 0.0, "2|2:9": 4.0}
    df = spark.createDataFrame(list(cases.items()), "gt string, want double")
    for r in df.select("want", dosage("gt", missing=0).alias("d")).collect():
        assert r.d == r.want
    miss = spark.createDataFrame([("./.",)], "gt string").select(dosage("gt", missing=-1).alias("d")).first().d
    assert miss == -1.0


def test_dosage_sqrt(spark):
    df = spark.createDataFrame([("1|1",), ("0|1",), ("0/1",)], "gt string")
    got = [r.d for r in df.select(dosage_sqrt("gt").alias("d")).collect()]
    assert got[0] == pytest.approx(2 ** 0.5) and got[1] == 1.0 and got[2] is None


def test_bmi_golden(spark):
    pairs = [(170.0, 74.0, 25.6055), (1.70, 74.0, 25.6055), (200.0, 150.0, 37.5), (2.00, 150.0, 37.5),
             (130.0, 150.0, 88.7574), (1.30, 150.0, 88.7574), (0.0, 80.0, 0.0), (170.0, -1.0, 0.0)]
    df = spark.createDataFrame(pairs, "h double, w double, want double")
    for r in df.select("want", bmi("h", "w").alias("b")).collect():
        assert r.b == pytest.approx(r.want, abs=1e-4)


def test_sex_code_exact_and_ignore_case(spark):
    df = spark.createDataFrame([("FEMALE",), ("MALE",), ("male",), (None,)], "s string")
    assert [r.c for r in df.select(sex_code("s").alias("c")).collect()] == [0, 1, -1, -1]
    assert [r.c for r in df.select(sex_code("s", True).alias("c")).collect()] == [0, 1, 1, -1]


def test_round_half_up(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (-1.5,), (2.4,)], "x double")
    assert [r.r for r in df.select(round_half_up("x").alias("r")).collect()] == [1, 2, 0, -1, 2]


def _ari(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    return metrics.adjusted_rand_index(df, "a", "b").first().ari


def test_ari_golden(spark):
    c1 = [0, 0, 0, 0, 1, 1, 1, 1]
    assert _ari(spark, c1, c1) == 1.0
    assert _ari(spark, c1, [0, 1, 0, 1, 0, 1, 0, 1]) == pytest.approx(-0.16666666666666674, abs=1e-15)


def test_ari_no_int_overflow(spark):
    # five equal clusters of 500: pair-count products exceed 2^31
    a = [i // 500 for i in range(2500)]
    b = [(i // 500 + (1 if i % 50 == 0 else 0)) % 5 for i in range(2500)]
    v = _ari(spark, a, b)
    assert 0.9 < v < 1.0


def test_ari_degenerate_is_one(spark):
    assert _ari(spark, [0, 0, 0], [1, 1, 1]) == 1.0


def test_group_filter_counts(spark):
    # 9-row panel, one id repeated three times: the original's include/exclude expectations
    rows = [("HG1", "a1"), ("HG1", "a1"), ("HG1", "a2"), ("HG2", "a2"), ("HG3", "b1"),
            ("HG4", "b2"), ("HG5", "b2"), ("HG6", "c1"), ("HG7", "c2")]
    df = spark.createDataFrame(rows, "individual string, population string")

    def n(inc, exc):
        return filter_groups(df, inc, exc).count()

    assert n([], []) == 9
    assert n(["a1"], []) == 2
    assert n(["a1", "a2"], []) == 4
    assert n(["a1", "a2"], [""]) == 4
    assert n(["a1", "a2"], ["b1", "b2"]) == 4
    assert n(["a1", "a2", "c1"], ["c1"]) == 4
    assert n(["a1", "a2", "c1"], []) == 5
    assert n([], ["b1"]) == 8
    assert n([], ["b1", "b2"]) == 6


def test_importance_golden_tree(spark):
    # seven hand-written nodes in three trees
    nodes = spark.createDataFrame([
        (0, 0, 0, -1, 0, 40, 0.0, 1, 0.24, 0.50, 100), (0, 1, 0, 0, 0, 80, 1.0, 0, 0.1667, 0.30, 60),
        (0, 1, 3, 0, 1, -1, 0.0, 1, 0.00, 0.20, 40), (0, 2, 0, 0, 0, -1, 0.0, 0, 0.00, 0.15, 40),
        (0, 2, 5, 0, 1, -1, 0.0, 1, 0.00, 0.10, 20), (1, 0, 0, -1, 0, -1, 0.0, 0, 0.00, 0.40, 100),
        (2, 0, 0, -1, 0, -1, 0.0, 1, 0.00, 0.45, 100)],
        "tree long, depth long, node long, parent long, side long, variable long, threshold double, majority long, "
        "gain double, impurity double, size long")
    imp = {r.variable: r.importance for r in forest.importance(nodes, 3).collect()}
    assert imp[40] == pytest.approx(0.08)
    assert imp[80] == pytest.approx(0.0333333, abs=1e-6)
    assert set(imp) == {40, 80}


def test_majority_vote_tie_to_largest(spark):
    v = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 3), (1, 0)], "s int, label int")
    got = {r.s: r.vote for r in metrics.majority_vote(v, ["s"], "label").collect()}
    assert got == {0: 2, 1: 3}


def test_gini_and_majority(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 1), (2, 3)], "g int, label int")
    got = {r.g: (r.majority, r.impurity, r.size) for r in metrics.gini(df, ["g"], "label").collect()}
    assert got[1][0] == 1 and got[1][1] == pytest.approx(0.5) and got[1][2] == 4
    assert got[2] == (3, 0.0, 1)


def test_dense_values_and_text(spark):
    from allelo.functions.dense import dense_text, dense_values

    df = spark.createDataFrame([(1, [(0, 5), (3, 7)]), (2, []), (3, [(4, 1)])],
                               "r int, e array<struct<i: int, v: int>>")
    got = {r.r: (r.d, r.t) for r in df.select(
        "r", dense_values("e", 5, 0).alias("d"),
        F.array_join(
            F.transform(dense_values("e", 5, 0), lambda x: x.cast("string")), ",").alias("t")).collect()}
    assert got[1] == ([5, 0, 0, 7, 0], "5,0,0,7,0")
    assert got[2] == ([0, 0, 0, 0, 0], "0,0,0,0,0")
    assert got[3] == ([0, 0, 0, 0, 1], "0,0,0,0,1")
    s = spark.createDataFrame([([(1, "2")],)], "e array<struct<i: int, v: string>>")
    assert s.select(dense_text("e", 3).alias("t")).first().t == "0,2,0"


def test_wide_csv_with_quotes(spark, tmp_path):
    from allelo.sources import tables_io

    (tmp_path / "a.csv").write_text('"","aBeta","f1","f,2","say ""x"""\n"s,1",0.6,1,2,3\n')
    (tmp_path / "b.csv").write_text('"","aBeta","f1","f,2","say ""x"""\ns2,0.4,,5,6\n')
    features, cells = tables_io.read_wide_csv(spark, f"{tmp_path}/a.csv,{tmp_path}/b.csv")
    assert [r["name"] for r in features.orderBy("feature_index").collect()] == ["f1", "f,2", 'say "x"']
    rows = sorted((r["id"], r["feature_index"], r["x"]) for r in cells.where("x is not null").collect())
    assert rows == [("s,1", 0, 1.0), ("s,1", 1, 2.0), ("s,1", 2, 3.0), ("s2", 1, 5.0), ("s2", 2, 6.0)]
    assert tables_io.feature_by_name(features, "f1").count() == 1
    (tmp_path / "c.csv").write_text('"","aBeta","other"\n')
    with pytest.raises(ValueError):
        tables_io.read_wide_csv(spark, f"{tmp_path}/a.csv,{tmp_path}/c.csv")
