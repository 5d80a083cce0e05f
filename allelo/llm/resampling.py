"""Importance resampling of documents towards a target distribution of hashed n-grams.

A feature is a run of one to ``most`` consecutive words; its bucket is the CRC-32
of its UTF-8 bytes modulo ``buckets``.  The log-ratio of a bucket's share in the
target texts to its share in all documents is its gain, a document's weight the
floored mean of its features' gains, and weights with Gumbel noise seeded by the
document's id give a draw without replacement: the highest scores are taken.

Features are made by Arrow kernels over whole batches: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn a batch
into indices of distinct words.  Indices shifted against each other form n-grams;
each distinct pair (index of the run so far, next word) is hashed once, by
continuing the CRC of the run.  Gains are taken by bucket and reduced by segment.

Bounds: a task holds one batch, in slices of about ``SLICE`` bytes of text (a
longer text is a slice of its own), and one count a bucket.  The driver holds one
number a bucket.  Scores are ranked by a range sort: no task sees all documents,
and equal keys are told apart by a row number, so one id may fill many ranges.

Defined results: a null or empty text has no words, no features and weight 0, and
is not drawn; repeated rows are documents of their own; a null id is seeded by the
prefix alone and ranks after equal scores; no documents give no rows, and without
target texts every gain rests on the smoothing; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, narrow

BUCKETS = 10_000
SLICE = 16 << 20
SEED = 2024
#: fixed value: what separates words, after A-Z are lower-cased
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW_BITS = (1 << 33) - 1


@dataclass(frozen=True)
class Features:
    """What a feature is: runs of 1 to ``most`` words, hashed to ``buckets``."""

    most: int = 1
    buckets: int = BUCKETS


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts as one dictionary array, and the text each belongs to."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    # a separator at either end of a text leaves an empty string
    owner, words = pc.list_parent_indices(split), pc.list_flatten(split)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).dictionary_encode(), owner.filter(full).to_numpy().astype(np.int64)


def hashed(texts: pa.Array, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of every text, with repeats, the text each belongs to, and each text's words."""
    encoded, owner = words_of(texts)
    words = [w.encode() for w in encoded.dictionary.to_pylist()]
    index = encoded.indices.to_numpy().astype(np.int64)
    crc = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    spaced = [b" " + w for w in words]
    buckets, owners = [crc[index] % features.buckets if len(words) else index], [owner]
    run = index
    for length in range(2, features.most + 1):
        # run[i] is the distinct run that starts at word i; a word of the same text must follow
        follows = owner[length - 1:] == owner[:len(owner) - length + 1]
        run = run[:len(follows)]
        following = index[length - 1:]
        pairs = np.where(follows, run * len(words) + following, -1)
        distinct, run = np.unique(pairs, return_inverse=True)
        ends = ((crc[p // len(words)], spaced[p % len(words)]) if p >= 0 else (0, b"") for p in distinct.tolist())
        crc = np.array([zlib.crc32(w, int(c)) for c, w in ends], dtype=np.int64)
        buckets.append(crc[run[follows]] % features.buckets)
        owners.append(owner[:len(follows)][follows])
    return np.concatenate(buckets), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a batch of about ``SLICE`` bytes each, with their first row."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    part = np.cumsum(sizes) // SLICE
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
        yield int(a), texts.slice(int(a), int(b - a))


def histogram(texts: DataFrame, features: Features) -> np.ndarray:
    """Features of all rows of ``texts`` in each bucket: one partial array a task, summed by Spark."""
    def run(batches):
        counts = np.zeros(features.buckets, dtype=np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                counts += np.bincount(hashed(part, features)[0], minlength=features.buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    partial = narrow(texts, text="text").mapInArrow(run, "bucket long, n long")
    counts = np.zeros(features.buckets, dtype=np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the source, by bucket."""
    k, total, goal = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total + k) / ((s + 1.0) * (goal + k))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, features: Features) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, count, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for first, part in slices(batch.column(1)):
                buckets, owner, words[first:first + len(part)] = hashed(part, features)
                order = np.argsort(owner, kind="stable") if features.most > 1 else slice(None)
                buckets, owner = buckets[order], owner[order]
                if not len(owner):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                rows = first + owner[starts]
                total[rows] = np.add.reduceat(gain[buckets], starts)
                count[rows] = np.diff(np.r_[starts, len(owner)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(count), pa.array(total // np.maximum(count, 1))],
                names=["doc_id", "n_words", "n_features", "weight"])

    schema = f"doc_id {kind}, n_words long, n_features long, weight long"
    return narrow(docs, doc_id="doc_id", text="text").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the seeded SHA-256 of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, eligible: Column, scratch: Scratch) -> DataFrame:
    """``place`` 1, 2, 3... of eligible rows by falling score, ties to the smaller id; null for the others.

    A range sort, one count a range and their running sum: the only row set that meets in
    one task has a row a range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    chosen = scratch.write(
        rows.where(eligible).withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "sorted")
    counts = chosen.groupBy(F.shiftright("_at", 33).alias("_range")).count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    placed = (chosen.withColumn("_range", F.shiftright("_at", 33))
              .join(F.broadcast(offsets), "_range")  # one row a range
              .withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW_BITS)) + 1)
              .drop("_range", "_before", "_at"))
    return placed.unionByName(rows.where(~eligible).withColumn("place", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20,
             features: Features = Features(), seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document; rank is null if not drawn.

    ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(histogram(docs, features), histogram(target, features))
    scored = weigh(docs, gain, features).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scratch.write(scored, "scored")
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    out = ranked(scored, eligible, scratch)
    return out.select("doc_id", "n_words", "n_features", "weight", "score",
                      F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


#: the registered query in SQL; CRC-32 by its byte table, derived from the polynomial
ORACLE = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT 0 AS goal, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark
), split AS (
  SELECT goal, r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts
), words AS (
  SELECT goal, r, unnest(ws) AS w FROM split
), vocabulary AS (
  SELECT w, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(w)), 2),
                                              lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), tab
), counted AS (
  SELECT bucket, count(*) FILTER (goal = 0) AS s, count(*) FILTER (goal = 1) AS t
  FROM words JOIN vocabulary USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (S.a + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (S.b + 10000)::DOUBLE)))::BIGINT AS g
  FROM counted, (SELECT sum(s) AS a, sum(t) AS b FROM counted) S
), weighed AS (
  SELECT r, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight
  FROM words JOIN vocabulary USING (w) JOIN gain USING (bucket) WHERE goal = 0 GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE
    )))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (r) WHERE goal = 0
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
      PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
"""
