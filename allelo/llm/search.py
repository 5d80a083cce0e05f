"""Ranked lexical search: the best documents of a table for each item of a query table.

A term's weight falls with the number of documents that hold it; a document's
score sums, over the item's distinct terms, the weight times a saturated term
frequency that long documents dampen (integer arithmetic throughout).

Items are searched in blocks of about ``BLOCK_TERMS`` distinct terms, so what
travels to the tasks is bounded whatever the number of items.  For a block:

1. every text is read once and becomes a row of the block's terms it holds, with
   their frequencies and its length; document frequencies, the number of documents
   and all their terms are sums over these rows;
2. presence masks: in a batch of rows each term is a bitmap of rows.  For an item
   the bitmaps of its terms are combined into one mask a row, bit ``j`` for the
   item's term ``j``, and rows are grouped by mask.  A mask's maximum score takes
   the greatest frequency of each present term and the group's shortest document.
   Masks are evaluated by descending maximum; an item is safely finished when the
   next maximum is below its worst kept score (equal ones are still evaluated, as
   ties go to the smaller id).  The kept scores are carried from batch to batch;
3. a task returns the best rows of each item that it saw, at most ``k``, and these
   are ranked per item: at most ``k`` rows an item and task meet.

Bounds: a task holds a batch of term rows, one block's terms and ``k`` rows an
item; the driver holds one block's terms and numbers.  Every document is read and
counted for every block; no candidate is dropped but by the bound above.

Defined results: a null, empty or separator-only text has no terms, counts neither
as a document nor in the lengths, and is never found; an item without terms, or
whose terms no document holds, gets no rows; repeated rows (and several rows of one
id) are documents of their own; null ids rank last among equal scores; items of one
id are searched as one item each and their rows share the id; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, arrow_map, narrow

TOP = 10
BLOCK_TERMS = 20_000
#: rows of a batch whose masks are grouped together
ROWS = 8192
#: documents of the best masks that are scored at once, at first
CHUNK = 64
#: bits of one word of a mask
BITS = 62
#: fixed values: length normalisation in percent, saturation and scale of the frequency
LENGTH, SATURATION, SCALE = 90, 8, 1_000_000_000

# A-Z become a-z; every other ASCII character but letters and digits becomes a blank
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a whole text in order, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """A document's ``m``: 100 for one of average length."""
    return 100 - LENGTH + (LENGTH * n * n_docs) // length


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


# -- one batch of term rows ------------------------------------------------


class Batch:
    """Term rows by term: for each term the rows that hold it and its frequency in them."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray,
                 n_terms: int):
        order = np.argsort(terms, kind="stable")
        self.doc_ids, self.lengths = doc_ids, lengths
        self.rows, self.tf = rows[order], tf[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def bitmap(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.rows[a:b], self.tf[a:b]


def groups_by_mask(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every row with a bit set (numbered from 0), and those rows; one mask a column of words."""
    held = np.flatnonzero(masks.any(axis=0))
    group = np.zeros(len(held), dtype=np.int64)
    for word in masks:  # refine the groups by each word of the masks
        _, value = np.unique(word[held], return_inverse=True)
        _, group = np.unique(group * (value.max(initial=0) + 1) + value, return_inverse=True)
    return group, held


def best_of(batch: Batch, item: np.ndarray, weights: np.ndarray, m: np.ndarray, k: int, worst: int
            ) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that may be among an item's best ``k``, with their scores; ``worst`` is its kept bound."""
    n, t = len(batch.lengths), len(item)
    masks = np.zeros((-(-t // BITS), n), dtype=np.int64)
    tf = np.zeros((t, n), dtype=np.int64)
    for j, term in enumerate(item.tolist()):
        rows, times = batch.bitmap(term)
        masks[j // BITS, rows] |= 1 << j % BITS
        tf[j, rows] = times
    group, held = groups_by_mask(masks)
    if not len(held):
        return held, held
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
    sizes = np.diff(np.r_[starts, len(held)])
    shortest = np.minimum.reduceat(m[held[order]], starts)
    present = tf[:, held[order[starts]]] > 0
    most = tf.max(axis=1)
    ceiling = (weights[:, None] * present * saturated(most[:, None], shortest[None, :])).sum(axis=0)
    down = np.argsort(-ceiling, kind="stable")
    found_rows, found_scores, at, chunk = [], [], 0, max(CHUNK, k)
    while at < len(down):
        if ceiling[down[at]] < max(worst, 1):  # safely finished
            break
        end = at + 1 + int(np.searchsorted(np.cumsum(sizes[down[at:]]), chunk))
        taken = down[at:end]
        rows = np.concatenate([held[order[starts[g]:starts[g] + sizes[g]]] for g in taken.tolist()])
        scores = (weights[:, None] * saturated(tf[:, rows], m[rows][None, :])).sum(axis=0)
        good = scores >= max(worst, 1)
        found_rows.append(rows[good])
        found_scores.append(scores[good])
        kept = np.concatenate(found_scores)
        if len(kept) >= k:
            worst = max(worst, int(np.partition(kept, len(kept) - k)[len(kept) - k]))
        at, chunk = end, 2 * chunk
    if not found_rows:
        return held[:0], held[:0]
    return np.concatenate(found_rows), np.concatenate(found_scores)


# -- one block of items ------------------------------------------------------


def term_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tf)``: the block's terms each text holds; texts without any term at all drop out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most about BLOCK_TERMS terms
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(keys, texts):
        number = shared.value
        for key, text in zip(keys, texts, strict=True):
            words = terms_of(text)
            if words:
                counts = Counter(filter(number.__contains__, words))
                yield key, len(words), [number[w] for w in counts], list(counts.values())

    return arrow_map(narrow(docs, doc_id="doc_id", text="text"), run,
                     f"doc_id {kind}, n long, terms array<int>, tf array<int>")


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, list[int]]:
    """Documents, their terms, and each term's document frequency; a number a term reaches the driver."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = [0] * n_terms
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return total["n"], total["l"], df


def ranked_block(rows: DataFrame, items: list[tuple[int, list[int]]], weights: list[int], n_docs: int, length: int,
                 k: int) -> DataFrame:
    """``(slot, doc_id, score)``: of every task, its best ``k`` rows for each item of the block."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((items, weights))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = lambda kept: (-kept[1], kept[0] is None, kept[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        w = np.array(weights, dtype=np.int64)
        kept: list[list] = [[] for _ in items]
        wanted = [np.array([t for t in terms if weights[t] > 0], dtype=np.int64) for _, terms in items]
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                part = whole.slice(a, ROWS)
                lists, tf = part.column(2), part.column(3)
                batch = Batch(part.column(0).to_pylist(), part.column(1).to_numpy(),
                              lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy(),
                              tf.flatten().to_numpy().astype(np.int64), len(w))
                m = damping(batch.lengths, n_docs, length)
                for i, terms in enumerate(wanted):
                    worst = kept[i][-1][1] if len(kept[i]) == k else 1
                    found, scores = best_of(batch, terms, w[terms], m, k, worst)
                    if len(found):
                        mine = [(batch.doc_ids[r], s) for r, s in zip(found.tolist(), scores.tolist(), strict=True)]
                        kept[i] = sorted(kept[i] + mine, key=order)[:k]
        out = [(slot, doc, score) for (slot, _), best in zip(items, kept, strict=True) for doc, score in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], type=pa.int64()),
             pa.array([o[1] for o in out], type=whole_type), pa.array([o[2] for o in out], type=pa.int64())],
            names=["slot", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    whole_type = to_arrow_type(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(run, f"slot long, doc_id {kind}, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """``(slot, item_id, terms)``: the distinct terms of every item that has one, under a number of its own."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(keys, texts):
        for key, text in zip(keys, texts, strict=True):
            terms = list(dict.fromkeys(terms_of(text)))
            if terms:
                yield key, terms

    rows = arrow_map(narrow(items, item_id="item_id", text="text"), run, f"item_id {kind}, terms array<binary>")
    return rows.withColumn("slot", F.monotonically_increasing_id())


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item with a score above 0."""
    scratch = Scratch(docs.sparkSession, "search")
    queries = scratch.write(item_terms(items), "items")
    size = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_terms))
    block = F.pmod(F.xxhash64("slot"), F.lit(blocks))
    for b in range(blocks):
        members = queries.where(block == b).select("slot", "terms").orderBy("slot").collect()  # one block
        vocabulary: dict[bytes, int] = {}
        coded = [(r["slot"], [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]]) for r in members]
        rows = scratch.write(term_rows(docs, vocabulary), f"rows-{b}")
        n_docs, length, df = statistics(rows, len(vocabulary))
        weights = [weight(n_docs, f) for f in df]
        best = ranked_block(rows, coded, weights, n_docs, length, k)
        scratch.write(best, f"best/block={b}")
        scratch.drop(f"rows-{b}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.sparkSession.read.schema(f"slot long, doc_id {kind}, score long").parquet(f"{scratch.root}/best")
    first = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .join(queries.select("slot", "item_id"), "slot").select("item_id", "rank", "doc_id", "score"))


#: the registered query in SQL
ORACLE = """
WITH split AS (
  SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS length FROM split WHERE len(ws) > 0
), tf AS (
  SELECT r, doc_id, n, w, count(*) AS tf
  FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM split) GROUP BY ALL
), weights AS (
  SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), total
), scored AS (
  SELECT i, item_id, r, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // length))))::BIGINT AS score
  FROM asked JOIN tf USING (w) JOIN weights USING (w), total GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
