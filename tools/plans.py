"""Print the physical plans of the headline operators (exchanges, joins, scans) into PLANS.md.

Usage: python tools/plans.py [sf_dir]  (default /root/testdata/sf0.01)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from allelo.operators import forest as fr  # noqa: E402
from allelo.operators import kmeans as km  # noqa: E402
from allelo.operators import matrix as mx  # noqa: E402
from allelo.plans.common import indexed  # noqa: E402
from allelo.session import get_spark  # noqa: E402

KEEP = ("Exchange", "Join", "Scan", "HashAggregate", "Window", "Generate", "MapInPandas", "TakeOrdered")


def excerpt(df) -> list[str]:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    return [ln.rstrip()[:160] for ln in final.split("\n") if any(k in ln for k in KEEP)]


def main(sf_dir: str) -> None:
    spark = get_spark()
    long, subjects, variants, x = indexed(spark, sf_dir, "planted", dense_variants=False)
    xp = km.prepare(x)
    c = km.initial_centres(xp, 5)
    a = km.assign(xp, c, subjects.select("subject_index"), 5, subjects.count()).checkpoint()
    new_c, _ = km.update(xp, a, 5, subjects.count())
    cells = x.select(F.col("subject_index").alias("sample_index"), "variant_index", "allele")
    labels = subjects.select(F.col("subject_index").alias("sample_index"),
                             (F.col("subject_index") % 5).cast("int").alias("label")).checkpoint()
    X = fr.prepare_cells(cells)
    n = labels.count()
    bag = fr.bootstrap(labels, n, 3, 1).checkpoint()
    st = bag.join(labels, "sample_index").select(
        "tree", "sample_index", F.lit(0).cast("bigint").alias("node"), "w", "label").checkpoint()
    tot = fr._node_totals(st, labels, 5, "gini").persist()
    sections = {
        "k-means distance step (X join centres -> n x k sums)": km.assign(xp, c, subjects.select("subject_index"),
                                                                            5, n),
        "k-means update (X join broadcast(assignment) -> groupBy variant)": new_c,
        "forest level: best split per (tree, node)": fr.best_splits(X, st, labels, tot, 5, 0.5, 3, "gini", 3 * n),
        "Gram tiles (mapInPandas block products)": mx.gram(x, n, tile=mx.tile_for(n)),
    }
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `tools/plans.py` on `{sf_dir}` (final adaptive plans; exchanges, joins, scans,",
           "aggregates and windows only).", ""]
    for title, df in sections.items():
        out += [f"## {title}", "", "```"] + excerpt(df) + ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
