"""Mixing sources to target weights by capped water-filling.

The mix holds ``share`` times all words.  Sources get targets in proportion to
their weights; a source stops at ``max_epochs`` times its own size and the
excess is shared again by weight among the others until none is above its cap,
which is the water level ``l`` with ``sum(min(cap, l * weight)) = total``.

A source whose target is ``q`` words repeats every document ``q div size``
times (whole repetitions); the rest is a seeded fractional repetition: the
source's documents in the order of a seeded hash, up to the remaining words,
the last of them in part.  The words taken of a source so equal its rounded
target, and no document exceeds ``max_epochs`` times its size.

Nothing is collected but two sums a step of the water level.  Running sums
within a source go over hash buckets, so a source holding a third of all rows
is ``BUCKETS`` groups, not one.

Defined results: null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; a null id sorts as an empty one;
repeated rows are documents of their own (rows alike in id and size may swap
their results); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, narrow

WEIGHTS = (3, 1, 2)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, 17
BUCKETS_HEX = 3  # hash digits that name a bucket: 4096 buckets


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_table(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``source, position, weight, size``: one row a source, in code point order, null last.

    The position is counted over ranges of sources, one row a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranked = totals.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    return ranked.withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")))


def water_level(sources: DataFrame, total: float, max_epochs: int = MAX_EPOCHS) -> float:
    """The level at which the clamped targets add up to ``total``; each step is one aggregate."""
    level = 0.0
    while True:
        capped = F.col("source_size") * max_epochs <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(capped, F.col("source_size") * max_epochs)).alias("full"),
                          F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return float("inf")
        higher = (total - (row["full"] or 0)) / row["weight"]
        if higher <= level:
            return level
        level = higher


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights=WEIGHTS,
        seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, whole, part``.

    ``whole`` repetitions of the document and ``part`` words of one more.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = narrow(docs, doc_id=doc_id, source=source, text=text).select(
        "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = scratch.write(sized, "sized")
    sources = scratch.write(source_table(sized, weights), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total, max_epochs)
    target = F.least(F.col("source_size") * float(max_epochs), F.lit(level) * F.col("weight"))
    quota = F.floor(target + 0.5)
    sources = (sources.withColumn("target", target).withColumn("quota", quota)
               .withColumn("whole", F.when(F.col("source_size") > 0,
                                           F.expr("quota div source_size")).otherwise(F.lit(0)).cast("long"))
               .withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size")))
    keyed = (sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
             .withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
             .withColumn("bucket", F.substring("h", 1, BUCKETS_HEX)))
    group = ["position", "bucket"]
    before = (keyed.groupBy(*group).agg(F.sum("size").alias("bucket_size"))
              .withColumn("offset", F.coalesce(F.sum("bucket_size").over(
                  Window.partitionBy("position").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0))).drop("bucket_size"))
    inside = Window.partitionBy(*group).orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return (keyed.join(before, group).withColumn("start", start)
            .select("doc_id", "source", "size", "source_size", "target", "whole", part.alias("part")))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them (a part of half or more counts as one).

    Rows alike in id and word count get the same number of copies.
    """
    copies = (mix(docs, **options)
              .withColumn("n", F.col("whole") + (2 * F.col("part") >= F.greatest(F.col("size"), F.lit(1))).cast("long"))
              .groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k"), F.col("size").alias("_size"))
              .agg(F.max("n").alias("_n")).where("_n > 0"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (docs.withColumn("_key", key).withColumn("_words", word_count(F.col("text")))
            .join(copies, (F.col("_key") == F.col("_k")) & (F.col("_words") == F.col("_size")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM totals),
steps AS (
  SELECT *, {SHARE} * sum(source_size) OVER () AS total,
    coalesce(sum({MAX_EPOCHS} * source_size) OVER w, 0) AS full_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
  FROM placed
  WINDOW w AS (ORDER BY {MAX_EPOCHS} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max((total - full_before) / weight_left) AS l FROM steps),
targets AS (
  SELECT source, source_size, least({MAX_EPOCHS} * source_size, coalesce(l, 'infinity'::DOUBLE) * weight)::DOUBLE AS target
  FROM placed, level),
quotas AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM targets),
running AS (
  SELECT s.doc_id, s.size, q.source_size, q.target,
    CASE WHEN q.source_size > 0 THEN q.quota // q.source_size ELSE 0 END AS whole, q.quota,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, quota - whole * source_size - start)) AS BIGINT) AS taken
FROM running
"""
