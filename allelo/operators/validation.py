"""Cross-validation and repeated evaluation of the wide forest in one growth.

The parts of an evaluation (folds, or repeated splits) are rows ``(part, sample_index,
train)``.  All their forests are grown together: tree ``part * n_trees + t`` is tree ``t``
of a part and its bag holds training samples only, so the part belongs to every key of the
growth and one scan of the cells per level serves all parts.  A part's trees are those
that a fit with its bag alone would give.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelo.operators import forest as fr
from allelo.operators.metrics import majority_vote


def fold_parts(folds: DataFrame, k: int) -> DataFrame:
    """``folds(sample_index, fold)`` as parts: a fold's samples are held out of its part."""
    every = folds.select("sample_index", "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("part"))
    return every.select(F.col("part").cast("bigint").alias("part"), "sample_index",
                        (F.col("fold") != F.col("part")).alias("train"))


def split_parts(splits: DataFrame) -> DataFrame:
    """``splits(run_id, sample_index, split)`` as parts: split 0 trains."""
    return splits.select(F.col("run_id").cast("bigint").alias("part"), "sample_index",
                         (F.col("split") == 0).alias("train"))


def part_bags(parts: DataFrame, n_samples: int, n_parts: int, params: fr.ForestParams) -> DataFrame:
    """The bags of all parts' trees: draws over all samples of which the training ones count."""
    samples = parts.select("sample_index").distinct()
    drawn = fr.bootstrap(samples, n_samples, n_parts * params.n_trees, params.seed, params.bootstrap)
    part = (F.col("tree") / F.lit(params.n_trees)).cast("bigint")
    trained = parts.where("train").select("part", "sample_index")
    return drawn.withColumn("part", part).join(trained, ["part", "sample_index"]).drop("part")


def fit_parts(cells: DataFrame, labels: DataFrame, parts: DataFrame, n_parts: int, n_labels: int,
              params: fr.ForestParams, x: DataFrame | None = None) -> fr.ForestModel:
    """The forests of all parts, ``params.n_trees`` trees each, as one model (``x``: the cells, prepared before)."""
    bag = part_bags(parts, labels.count(), n_parts, params)
    return fr.fit(cells, labels, n_labels, replace(params, n_trees=n_parts * params.n_trees), bag=bag, x=x)


def held_out(model: fr.ForestModel, labels: DataFrame, parts: DataFrame, n_trees: int,
             max_depth: int | None = None) -> DataFrame:
    """``(part, sample_index, label, prediction)``: every part's vote on the samples held out of it."""
    votes = fr.predict_trees(model.nodes, model.x, _held_trees(parts, n_trees), max_depth) \
        .withColumn("part", (F.col("tree") / F.lit(n_trees)).cast("bigint"))
    voted = majority_vote(votes, ["part", "sample_index"], "prediction").withColumnRenamed("vote", "prediction")
    return voted.join(labels, "sample_index").select("part", "sample_index", "label", "prediction")


def held_out_depths(model: fr.ForestModel, labels: DataFrame, parts: DataFrame, n_trees: int,
                    depths: tuple[int, ...]) -> DataFrame:
    """``held_out`` of the trees cut at each of ``depths`` (``max_depth``), from one walk."""
    votes = fr.predict_depths(model.nodes, model.x, _held_trees(parts, n_trees), depths) \
        .withColumn("part", (F.col("tree") / F.lit(n_trees)).cast("bigint"))
    voted = majority_vote(votes, ["max_depth", "part", "sample_index"], "prediction").withColumnRenamed("vote", "prediction")
    return voted.join(labels, "sample_index").select("max_depth", "part", "sample_index", "label", "prediction")


def _held_trees(parts: DataFrame, n_trees: int) -> DataFrame:
    """``(sample_index, tree)``: the samples held out of a part, with each tree of it."""
    return parts.where(~F.col("train")).select(
        "sample_index", F.explode(F.sequence(F.col("part") * n_trees, F.col("part") * n_trees + (n_trees - 1))).alias("tree"))


def evaluate(predictions: DataFrame, metric: Callable[[DataFrame, tuple[str, ...]], DataFrame], value: str
             ) -> tuple[DataFrame, DataFrame]:
    """Any metric by part, and its mean over the parts (``mean``, ``n_parts``).

    ``metric(predictions, by)`` gives a row a part with the column ``value``.
    """
    by_part = metric(predictions, ("part",))
    return by_part, by_part.agg(F.avg(value).alias("mean"), F.count(value).alias("n_parts"))
