"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (``SAMPLE`` vectors by a seeded hash):
nodes are split by k-means into ``BRANCH`` children down to leaves of about
``LEAF_ROWS`` rows of the whole table, or ``LEAF_SAMPLE`` vectors of the
sample.  Every row descends to its leaf by the nearest centre.  A query walks
the tree through a priority queue, best bin first: a node's priority is the
inner product with its centre plus the query's length times the node's radius
(root mean square).  It visits ``visits`` leaves, and goes on until they hold
enough rows.

``visits`` is calibrated: for ``CALIBRATE`` vectors the exact neighbours over
all rows are found by one scan, and visits are widened until the leaves
visited hold ``RECALL`` of them.

Leaves are dealt in blocks of about ``BLOCK`` rows, neighbours in the tree
together; a larger leaf is spread over several blocks.  A query goes once to
every block with leaves it visits, and blocks with many queries are repeated for
query parts, so a task holds one block of rows and one of queries.  Inner products
are taken in double precision on the original vectors; candidates are chosen by
matrix product and their scores then summed in one fixed order, so equal
vectors get equal scores.

Defined results: rows with a null id, and vectors that are null, empty, zero or
hold null or non-finite components take no part; nor do vectors of another
length than the most frequent one (ties: the shorter); rows that share an id
are one candidate with its best score, and never a candidate of their own id;
fewer than ``k`` candidates are all returned; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, bounded_sample, narrow

SAMPLE, BRANCH, LEAF_ROWS, LEAF_SAMPLE, ROUNDS = 20_000, 8, 512, 12, 8
CALIBRATE, RECALL = 100, 0.95
BLOCK, QUERY_PART = 8192, 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of an array column as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


class Tree:
    """Centres, radii and children of a hierarchical k-means tree; node 0 is the root."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 5):
        self.centres, self.radii, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        least = max(LEAF_SAMPLE, math.ceil(len(sample) / max(leaves, 1)))
        self.grow(sample, least, np.random.default_rng(seed))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def grow(self, rows: np.ndarray, least: int, rng) -> int:
        """Add the node of ``rows`` and everything below it; leaves are numbered depth first."""
        me = len(self.children)
        centre = rows.mean(axis=0)
        self.centres.append(centre)
        self.radii.append(math.sqrt(float(((rows - centre) ** 2).sum(axis=1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        parts = self.split(rows, rng) if len(rows) > least else []
        if len(parts) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
        else:
            self.children[me] = [self.grow(p, least, rng) for p in parts]
        return me

    def split(self, rows: np.ndarray, rng) -> list[np.ndarray]:
        distinct = np.unique(rows, axis=0) if len(rows) < 5000 else rows
        k = min(BRANCH, len(distinct))
        centres = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(ROUNDS):
            near = nearest(rows, centres)
            centres = np.array([rows[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
        near = nearest(rows, centres)
        return [rows[near == i] for i in range(k) if (near == i).any()]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(rows), dtype=np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            kids = self.children[node]
            near = nearest(rows[at], self.centres[kids])
            todo += [(kid, at[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        worth = self.centres @ query + math.sqrt(float(query @ query)) * self.radii
        queue = [(-worth[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (-worth[kid], kid))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row; ties go to the first."""
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order."""
    return np.add.reduce(rows * query, axis=1)


def best(query: np.ndarray, rough: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int,
         repeated: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the ``k`` best ids by (score, smaller id).

    ``rough``: products that choose the candidates; ``repeated``: how many rows repeat another's id.
    """
    near = np.arange(len(ids))
    if len(ids) > k + repeated:
        edge = np.partition(rough, len(ids) - k - repeated)[len(ids) - k - repeated]
        near = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    score = exact(query, rows[near])
    order = np.lexsort((ids[near], -score))
    if repeated:
        _, first = np.unique(ids[near][order], return_index=True)
        order = order[np.sort(first)]
    order = order[:k]
    return near[order], score[order]


class Index:
    """The tree over a table of vectors, with every row in a leaf."""

    def __init__(self, table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20,
                 sample: int = SAMPLE, recall: float = RECALL):
        spark = table.sparkSession
        self.k, self.scratch = k, Scratch(spark, "neighbours")
        rows = narrow(table, vec_id=vec_id, v=vector).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.dim = widths["d"] if widths else 0
        self.size = widths["count"] if widths else 0
        rows = rows.where(F.size("v") == self.dim)
        picked = bounded_sample(rows.withColumn("all", F.lit("")), "all", "vec_id", sample).select("vec_id", "v").toArrow()
        points = matrix(picked.column("v").combine_chunks(), self.dim) if self.size else np.zeros((0, 0))
        order = np.argsort(picked.column("vec_id").to_numpy(), kind="stable")
        points = points[order]
        self.tree = Tree(points, -(-self.size // LEAF_ROWS)) if self.size else None
        if self.tree:
            self.rows = self.scratch.write(self._assigned(rows), "rows")
            counts = {r["leaf"]: r["count"] for r in self.rows.groupBy("leaf").count().collect()}  # one row a leaf
            self.counts = np.array([counts.get(i, 0) for i in range(self.tree.leaves)])
            step = max(1, len(points) // CALIBRATE)
            self.visits = self._calibrated(points[::step][:CALIBRATE], recall)

    def _assigned(self, rows: DataFrame) -> DataFrame:
        tree, dim = self.tree, self.dim

        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(tree.assign(x)), pa.array([r.tobytes() for r in x], type=pa.binary())],
                    names=["vec_id", "leaf", "v"])

        return rows.mapInArrow(run, "vec_id long, leaf int, v binary")

    def _calibrated(self, queries: np.ndarray, recall: float) -> int:
        """The fewest visits that find ``recall`` of the queries' exact neighbours over all rows."""
        k, dim = self.k + 1, self.dim  # a query is among its own neighbours

        def run(batches) -> Iterator[pa.RecordBatch]:
            held: list[list[tuple]] = [[] for _ in queries]
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float64).reshape(-1, dim)
                ids, leaves = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                rough = queries @ x.T
                for i, q in enumerate(queries):
                    at, score = best(q, rough[i], x, ids, k)
                    held[i] = sorted(held[i] + list(zip((-score).tolist(), ids[at].tolist(), leaves[at].tolist(),
                                                        strict=True)))[:k]
            found = [(i, s, v, leaf) for i, rows in enumerate(held) for s, v, leaf in rows]
            yield pa.RecordBatch.from_pylist([{"q": i, "s": s, "vec_id": v, "leaf": leaf} for i, s, v, leaf in found],
                                             schema=pa.schema([("q", pa.int32()), ("s", pa.float64()),
                                                               ("vec_id", pa.int64()), ("leaf", pa.int32())]))

        near = self.rows.mapInArrow(run, "q int, s double, vec_id long, leaf int")
        top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("s", "vec_id"))).where(F.col("r") <= k)
        wanted = top.select("q", "leaf").collect()  # CALIBRATE * (k + 1) rows
        place = [{leaf: n for n, leaf in enumerate(self.tree.visit(q))} for q in queries]
        needed = sorted(place[r["q"]][r["leaf"]] + 1 for r in wanted)
        return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]

    def _blocks(self) -> tuple[np.ndarray, np.ndarray, int]:
        """First block and number of blocks of every leaf, and the number of blocks."""
        first, number, block, held = [], [], 0, 0
        for n in self.counts.tolist():
            if held and held + n > BLOCK:
                block, held = block + 1, 0
            first.append(block)
            number.append(max(1, -(-n // BLOCK)))
            held += n
            if number[-1] > 1:
                block, held = block + number[-1], 0
        return np.array(first), np.array(number), block + 1

    def search(self, queries: Column) -> DataFrame:
        """``query_id, rank, vec_id, score``: the neighbours of the rows where ``queries`` (over vec_id) holds."""
        spark = self.scratch.spark
        schema = "query_id long, rank int, vec_id long, score double"
        if not self.tree:
            return spark.createDataFrame([], schema)
        first, number, _ = self._blocks()
        asked = self.scratch.write(self._sent(self.rows.where(queries).select("vec_id", "v"), first, number), "asked")
        per_block = {r["block"]: -(-r["count"] // QUERY_PART) for r in asked.groupBy("block").count().collect()}
        asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.element_at(
            F.create_map(*[F.lit(x) for kv in per_block.items() for x in kv]) if per_block else F.lit(None), F.col("block")))
            ) if per_block else asked.withColumn("part", F.lit(0).cast("long"))
        offered = self._offered(first, number, per_block)
        found = (asked.groupBy("block", "part").cogroup(offered.groupBy("block", "part"))
                 .applyInArrow(self._matcher(), "query_id long, vec_id long, score double"))
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return (found.withColumn("rank", rank).where(F.col("rank") <= self.k)
                .select("query_id", "rank", "vec_id", "score"))

    def _sent(self, queries: DataFrame, first: np.ndarray, number: np.ndarray) -> DataFrame:
        """``block, query_id, v, leaves``: every query for every block with leaves it visits."""
        tree, counts, visits, enough = self.tree, self.counts, self.visits, self.k + 1

        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    blocks: dict[int, list[int]] = {}
                    seen = total = 0
                    for leaf in tree.visit(np.frombuffer(raw)):
                        for b in range(first[leaf], first[leaf] + number[leaf]):
                            blocks.setdefault(int(b), []).append(leaf)
                        seen, total = seen + 1, total + int(counts[leaf])
                        if seen >= visits and total >= enough:
                            break
                    rows += [(b, key, raw, leaves) for b, leaves in blocks.items()]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], type=pa.int32()), pa.array(cols[1], type=pa.int64()),
                     pa.array(cols[2], type=pa.binary()), pa.array(cols[3], type=pa.list_(pa.int32()))],
                    names=["block", "query_id", "v", "leaves"])

        return queries.mapInArrow(run, "block int, query_id long, v binary, leaves array<int>")

    def _offered(self, first: np.ndarray, number: np.ndarray, per_block: dict[int, int]) -> DataFrame:
        """``block, part, vec_id, leaf, v``: every row in its block, once for each part of the block's queries."""
        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, leaves, spread = (batch.column(i).to_numpy() for i in (0, 1, 3))
                block = first[leaves] + spread % number[leaves]
                parts = np.array([per_block.get(int(b), 0) for b in block], dtype=np.int64)
                at = np.repeat(np.arange(len(ids)), parts)
                part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[at].astype(np.int32)), pa.array(part), pa.array(ids[at]), pa.array(leaves[at]),
                     batch.column(2).take(pa.array(at))], names=["block", "part", "vec_id", "leaf", "v"])

        spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
        return self.rows.withColumn("spread", spread).mapInArrow(
            run, "block int, part long, vec_id long, leaf int, v binary")

    def _matcher(self):
        k, dim = self.k, self.dim

        def match(asked: pa.Table, offered: pa.Table) -> pa.Table:
            schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            if not asked.num_rows or not offered.num_rows:
                return schema.empty_table()
            vectors = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=np.float64).reshape(-1, dim)
            x, q = vectors(offered), vectors(asked)
            ids, leaf = offered.column("vec_id").to_numpy(), offered.column("leaf").to_numpy()
            by_leaf = {int(v): np.flatnonzero(leaf == v) for v in np.unique(leaf)}
            repeated = len(ids) - len(np.unique(ids))
            out = [[], [], []]
            for i, (key, leaves) in enumerate(zip(asked.column("query_id").to_pylist(),
                                                  asked.column("leaves").to_pylist(), strict=True)):
                at = np.concatenate([by_leaf[v] for v in leaves if v in by_leaf] or [np.zeros(0, dtype=np.int64)])
                at = at[ids[at] != key]
                if len(at):
                    near = x[at]
                    some, score = best(q[i], near @ q[i], near, ids[at], k, repeated)
                    out[0] += [key] * len(some)
                    out[1] += ids[at[some]].tolist()
                    out[2] += score.tolist()
            return pa.table([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        return match
