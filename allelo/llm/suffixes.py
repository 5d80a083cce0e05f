"""Repeated passages by external induced suffix sorting.

Every byte is removed that a string of ``LENGTH`` bytes covers which also
starts in a document with a smaller id.  Windows are the strings of that length.

Sorting all suffixes of a corpus costs many times its size, so only a sample is
sorted and the rest is induced from it, as in induced sorting, with a sample
that is the same wherever a window occurs:

1. sample: a window's anchor is the leftmost of its ``K``-byte strings with the
   smallest hash.  Equal windows have equal anchors at equal distances.  The
   windows of one anchor form a run, about one in 18 bytes;
2. anchors meet by hash: one exchange, sorted by anchor, run and document, that a task
   reads as a stream.  Runs with equal content are settled at once: all but the
   smallest document's are repeats.  Runs whose anchor no other document holds cannot
   repeat.  A task holds the runs that the smallest document has of one anchor;
3. what is left, one occurrence of every differing run of a shared anchor, is
   dealt in shards by anchor.  A shard is sorted by the bytes from the anchor on
   (the sampled suffixes; Spark's external sort, spilling to disk), then the
   order of the suffixes one byte further left is induced: tuples go through a
   disk-backed queue ordered by (byte, rank), and common-prefix values are
   carried along as minima between equal bytes.  After ``n`` inductions windows
   that start ``n`` bytes before their anchors stand in order, and a common
   prefix of ``LENGTH`` marks equal ones; at most ``LENGTH - K`` inductions are
   needed.  The queue keeps ``QUEUE_ROWS`` tuples in memory, so a shard may be
   far larger than memory.

A task settles what it can before the exchange, so a large group of copies sends its anchors
about one row a task.  Anchors that would fill a good part of a task (more than one in ``HOT_SHARE`` rows of a
partition's share, by a first pass over one in ``SAMPLE`` documents) are split: in step 2
by the run's hash, and in step 3 their windows are dealt one by one, by 128-bit hashes,
and meet in an aggregate that combines in each task.  Which way an anchor goes changes
no result.

Defined results: null text is empty; texts shorter than a window stay whole;
rows with a null id stay whole and repeat nothing; rows that share an id do not
repeat each other, each has its own result; an empty table gives no rows; extra
columns are ignored (``remove`` returns all columns).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, narrow

LENGTH, K = 50, 16
WINDOW = LENGTH - K + 1  # anchors a window can choose from; also the inductions, with the first order
PIECE = 1 << 19  # bytes handled at a time
QUEUE_ROWS = 400_000
BLOCK_ROWS = 100_000
RUNS_AT_ONCE = 500_000  # runs of a task among which repeats are settled before they are dealt
#: documents of which one shows which anchors are hot; rows of a partition of which more than one makes it so
SAMPLE, HOT_SHARE, HOT_LEAST = 32, 8, 8

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 2 * LENGTH)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def runs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Runs of windows of the pieces ``buffer[starts[i]:ends[i]]``: piece, anchor, first, last, h, f.

    ``h`` hashes the anchor's string; ``f`` hashes the run's bytes and where the
    anchor stands in them.  Positions are in the buffer.
    """
    n = len(buffer)
    if n < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    x = buffer.astype(np.uint64)
    x = x[:-1] | x[1:] << _U(8)
    x = x[:-2] | x[2:] << _U(16)
    x = x[:-4] | x[4:] << _U(32)
    kmers = _mix(x[:-8] * _U(_BASE) + _mix(x[8:]))
    low = (kmers & _U(0xFFFFFFFF00000000)) | np.arange(len(kmers), dtype=np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span:])
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    count = np.maximum(ends - starts - LENGTH + 1, 0)
    inside = np.zeros(len(at) + 1, dtype=np.int8)
    has = count > 0
    np.add.at(inside, starts[has], 1)
    np.add.at(inside, starts[has] + count[has], -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(windows):
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    at = at[windows]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, last, anchor = windows[new], windows[np.append(new[1:], len(windows)) - 1], at[new]
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buffer] * down[:n], out=sums[1:])
    content = (sums[last + LENGTH] - sums[first]) * up[first]
    place = ((anchor - first) << 8 | (last - first)).astype(np.uint64)
    return (np.searchsorted(starts, anchor, side="right") - 1, anchor, first, last, kmers[anchor],
            _mix(content + place * _U(0xE7037ED1A0B428DB)))


def pieces_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about ``PIECE`` bytes: (buffer, owner, offset in the text, starts, ends) of their pieces.

    Pieces of a long text overlap by a window less one byte: every window is in exactly one.
    """
    parts, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[at: at + PIECE + LENGTH - 1]
            parts.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts):
    lengths = np.array([len(p) for _, _, p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    return (np.frombuffer(b"".join(p for _, _, p in parts), dtype=np.uint8), np.array([i for i, _, _ in parts]),
            np.array([at for _, at, _ in parts], dtype=np.int64), ends - lengths, ends)


# a run in one number: the anchor's place, 6 bits of windows left of it, 6 of windows less one
def pack(anchor, left, more):
    return anchor << 12 | left << 6 | more


def unpack(packed):
    return packed >> 12, packed >> 6 & 63, packed & 63


def _text_hash(text: str = "text"):
    return F.xxhash64(F.col(f"`{text}`"))


def _tag(docs: DataFrame, doc_id: str, text: str):
    """A column that tells rows with one id and different texts apart: 0 where no id has two texts."""
    several = (docs.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`"))
               .agg(F.min(_text_hash(text)).alias("low"), F.max(_text_hash(text)).alias("high"),
                    F.count_if(F.col(f"`{text}`").isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"))
               .where("low < high or (nulls > 0 and nulls < rows)"))
    return _text_hash(text) if several.limit(1).count() else F.lit(0).cast("long")


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _repeated(h: np.ndarray, f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for the runs of which these rows hold one of a smaller document."""
    order = np.lexsort((doc, f, h))
    h, f, doc = h[order], f[order], doc[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])]
    least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.zeros(len(order), dtype=bool)
    out[order] = doc > least
    return out


def _runs_of(tagged: DataFrame) -> DataFrame:
    """``h, f, doc, tag, run, done`` of every run of windows; ``done``: a smaller document of the same batch has it."""
    names = ["h", "f", "doc", "tag", "run", "done"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, size = [], 0
            for buffer, owner, offset, starts, ends in pieces_of(_raw(batch.column(2))):
                piece, anchor, first, last, h, f = runs(buffer, starts, ends)
                who = owner[piece]
                place = anchor - starts[piece] + offset[piece]
                held.append((h.view(np.int64), f.view(np.int64), docs[who], tags[who],
                             pack(place, anchor - first, last - first)))
                size += len(h)
                if size >= RUNS_AT_ONCE:
                    yield settled_here(held)
                    held, size = [], 0
            if held:
                yield settled_here(held)

    def settled_here(held) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(_repeated(*columns[:3]))], names=names)

    return tagged.where("doc_id is not null").mapInArrow(
        run, "h long, f long, doc long, tag long, run long, done boolean")


def _hot(tagged: DataFrame, parts: int) -> DataFrame:
    """``hot, salts``: anchors with more than a ``HOT_SHARE``-th of a partition's share of all runs.

    At most ``HOT_SHARE`` for each partition can be, so the table is bounded.
    """
    some = _runs_of(tagged.where(F.pmod(F.xxhash64("doc_id", "tag", F.lit(17)), F.lit(SAMPLE)) == 0)).select("h")
    counts = some.groupBy("h").count()
    least = max(some.count() / (parts * HOT_SHARE), float(HOT_LEAST))
    return counts.where(F.col("count") > least).select(
        F.col("h").alias("hot"), F.ceil(F.col("count") / F.lit(least)).alias("salts"))


class _Anchor:
    """The anchor that a stream of sorted runs stands in: its last class, and rows that wait for a second document."""

    def __init__(self, h: int, salt: int, f: int, least: int, low: int, high: int, waiting: list):
        self.key, self.f, self.least, self.low, self.high, self.waiting = (h, salt), f, least, low, high, waiting


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by anchor, content and document: settled repeats, and what is left to compare.

    A run waits only while all of its anchor's classes have the same smallest document.
    """
    names = ["open", "hot", "doc", "tag", "run"]
    at: _Anchor | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        salt, h, f, doc = (batch.column(i).to_numpy() for i in range(4))
        new_anchor = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
        new_class = new_anchor | np.r_[True, f[1:] != f[:-1]]
        starts = np.flatnonzero(new_class)
        least = doc[starts].copy()
        same = at is not None and at.key == (h[0], salt[0])
        if same and at.f == f[0]:
            least[0] = at.least
        groups = np.flatnonzero(new_anchor[starts])
        low, high = np.minimum.reduceat(least, groups), np.maximum.reduceat(least, groups)
        if same:
            low[0], high[0] = min(low[0], at.low), max(high[0], at.high)
        group = np.cumsum(new_anchor) - 1
        repeat = (doc > least[np.cumsum(new_class) - 1]) | (salt < 0)
        several = (low < high)[group] | (salt > 0)  # the parts of a split anchor cannot tell: all is compared
        out = repeat | several
        rest = batch.select(["doc", "tag", "run"])
        if out.any():
            kept = rest.filter(pa.array(out))
            yield pa.RecordBatch.from_arrays([pa.array(~repeat[out]), pa.array(salt[out] > 0), *kept.columns], names=names)
        waiting = at.waiting if same else []
        if same and waiting and several[0]:
            for rows in waiting:
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, dtype=bool)), pa.array(np.zeros(n, dtype=bool)),
                                                  *rows.columns], names=names)
            waiting = []
        if len(groups) > 1:
            waiting = []
        last = (group == group[-1]) & ~out
        if last.any():
            waiting = [*waiting, rest.filter(pa.array(last))]
        at = _Anchor(h[-1], salt[-1], f[-1], least[-1], low[-1], high[-1], waiting)


def _compare(found: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """``open, hot, doc, tag, run`` of all runs: settled repeats (not open) and runs to compare.

    Settled: a smaller document has the same run.  To compare: the smallest
    document's occurrences of every run, where an anchor has several runs and documents.
    """
    salt = (F.when(F.col("done"), F.lit(-1)).when(F.col("hot").isNotNull(), 1 + F.pmod(F.col("f"), F.col("salts")))
            .otherwise(F.lit(0)))
    # repeats that a task has settled itself need not meet their anchor: they are spread
    anywhere = F.when(F.col("done"), F.xxhash64("doc", "run")).otherwise(F.col("h"))
    dealt = (found.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left")  # HOT_SHARE rows a partition at most
             .select(salt.cast("int").alias("salt"), anywhere.alias("h"), "f", "doc", "tag", "run"))
    return (dealt.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "f", "doc")
            .mapInArrow(_settle, "open boolean, hot boolean, doc long, tag long, run long"))


def _with_text(tagged: DataFrame, compare: DataFrame) -> DataFrame:
    """``doc_id, tag, text, runs`` of the texts with runs to compare."""
    listed = (compare.groupBy(F.col("doc").alias("d"), F.col("tag").alias("t"))
              .agg(F.collect_list(F.struct("run", "hot")).alias("runs")))
    return tagged.join(listed, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t"))).select(
        "doc_id", "tag", "text", "runs")


def _around(texts: DataFrame) -> DataFrame:
    """``right, left, doc, tag, run, window``: the bytes from the anchor on and, backwards, those before it.

    For a run of a hot anchor: a row for each window, with the hash of its bytes in ``window`` and
    its start in ``run``.  Rows alike in id and text give the same tuples.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, text, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                              _raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                right, left, place, window = [], [], [], []
                for p in packed:
                    a, before, more = unpack(p["run"])
                    first = a - before
                    if p["hot"]:
                        for start in range(first, first + more + 1):
                            right.append(None)
                            left.append(None)
                            place.append(start)
                            window.append(hashlib.blake2b(text[start: start + LENGTH], digest_size=16).digest())
                    else:
                        right.append(text[a: first + more + LENGTH])
                        left.append(text[first: a][::-1])
                        place.append(p["run"])
                        window.append(None)
                n = len(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(right, type=pa.binary()), pa.array(left, type=pa.binary()),
                     pa.array([doc] * n, type=pa.int64()), pa.array([tag] * n, type=pa.int64()),
                     pa.array(place, type=pa.int64()), pa.array(window, type=pa.binary())],
                    names=["right", "left", "doc", "tag", "run", "window"])

    return texts.mapInArrow(run, "right binary, left binary, doc long, tag long, run long, window binary")


def _windows(around: DataFrame) -> DataFrame:
    """``doc, tag, start``: windows of hot anchors that a smaller document holds."""
    rows = around.where("window is not null").select("window", "doc", "tag", F.col("run").alias("start"))
    least = (rows.groupBy("window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
             .select(F.col("window").alias("w"), "low"))
    return rows.join(least, F.col("window") == F.col("w")).where("doc > low").select("doc", "tag", "start")


TUPLE = np.dtype([("left", "u1", WINDOW), ("doc", "i8"), ("tag", "i8"), ("run", "i8"), ("low", "u1"), ("high", "u1"), ("lcp", "u1")])


class Queue:
    """Tuples by (byte, time of arrival): the order (byte, rank) when pushed by rank.

    Lanes beyond ``rows`` tuples in all are moved to an unnamed file that ends
    with the task, as Spark's own sorter does with its runs.
    """

    def __init__(self, rows: int = QUEUE_ROWS):
        self.most, self.held = rows, 0
        self.lanes: list[list] = [[] for _ in range(256)]
        self.file = None

    def push(self, keys: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        rows, keys = rows[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        for at, end in zip(first, np.append(first[1:], len(keys)) if len(first) else [], strict=True):
            self.lanes[keys[at]].append(rows[at:end])
        self.held += len(rows)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for lane in self.lanes:
            kept = [x for x in lane if isinstance(x, np.ndarray)]
            if kept:
                block = np.concatenate(kept)
                lane[:] = [x for x in lane if not isinstance(x, np.ndarray)] + [(self.file.seek(0, 2), len(block))]
                self.file.write(block.tobytes())
        self.held = 0

    def drain(self) -> Iterator[np.ndarray]:
        """All tuples in order, in blocks."""
        waiting, size = [], 0
        for lane in self.lanes:
            for x in lane:
                for block in [x] if isinstance(x, np.ndarray) else self.read(*x):
                    waiting.append(block)
                    size += len(block)
                    if size >= BLOCK_ROWS:
                        yield np.concatenate(waiting)
                        waiting, size = [], 0
            lane.clear()
        if waiting:
            yield np.concatenate(waiting)
        if self.file:
            self.file.close()

    def read(self, at: int, count: int) -> Iterator[np.ndarray]:
        for k in range(0, count, BLOCK_ROWS):
            n = min(BLOCK_ROWS, count - k)
            self.file.seek(at + k * TUPLE.itemsize)
            yield np.frombuffer(self.file.read(n * TUPLE.itemsize), dtype=TUPLE)


class Minima:
    """Range minima of a block's common-prefix values by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        span = 1
        while 2 * span <= len(values):
            v = self.levels[-1]
            self.levels.append(np.minimum(v[:-span], v[span:]))
            span *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of ``values[low:high]`` for non-empty ranges."""
        out = np.empty(len(low), dtype=np.uint8)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            s = level == k
            v = self.levels[k]
            out[s] = np.minimum(v[low[s]], v[high[s] - (1 << int(k))])
        return out


def induce(blocks: Iterator[np.ndarray], distance: int, queue: Queue | None) -> Iterator[np.ndarray]:
    """Take the tuples in the order of their suffixes ``distance`` bytes before the anchor.

    Yields the tuples whose window there a smaller document holds too, and
    pushes the tuples that reach further left into ``queue`` with the
    common-prefix value they have in the next order.
    """
    since = np.full(256, -1, dtype=np.int16)  # least value since the byte's last tuple; -1: none yet
    held = None
    for block in _with_end(blocks):
        if block is None:
            block, cut = held, len(held) if held is not None else 0
        else:
            block = block if held is None or not len(held) else np.concatenate([held, block])
            opens = np.flatnonzero(block["lcp"] < LENGTH)
            cut = int(opens[-1]) if len(opens) else 0  # the last class may go on
        if not cut:
            held = block
            continue
        block, held = block[:cut], block[cut:]
        here = (block["low"] <= distance) & (distance <= block["high"])
        first = np.flatnonzero(np.concatenate([[True], block["lcp"][1:] < LENGTH]))
        docs = np.where(here, block["doc"], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(docs, first)
        of = np.repeat(least, np.diff(np.append(first, cut)))
        again = here & (block["doc"] > of)
        if again.any():
            yield block[again]
        if queue is not None:
            push(block, distance, queue, since)


def _with_end(blocks):
    yield from blocks
    yield None


def push(block: np.ndarray, distance: int, queue: Queue, since: np.ndarray) -> None:
    further = np.flatnonzero(block["high"] > distance)
    minima = Minima(block["lcp"])
    n = len(block)
    whole = int(block["lcp"].min())
    before = since.copy()
    np.copyto(since, np.where(since >= 0, np.minimum(since, whole), since))
    if not len(further):
        return
    keys = block["left"][further, distance]
    order = np.argsort(keys, kind="stable")
    at, key = further[order], keys[order]
    start = np.concatenate([[True], key[1:] != key[:-1]])
    value = np.empty(len(at), dtype=np.int16)
    inner = np.flatnonzero(~start)
    value[inner] = 1 + minima.of(at[inner - 1] + 1, at[inner] + 1).astype(np.int16)
    begin = np.flatnonzero(start)
    prior = before[key[begin]]
    lead = np.minimum(prior, minima.of(np.zeros(len(begin), dtype=np.int64), at[begin] + 1))
    value[begin] = np.where(prior >= 0, 1 + lead, 0)
    last = np.append(begin[1:], len(at)) - 1
    tail = at[last] + 1
    rest = np.full(len(last), LENGTH, dtype=np.int16)
    some = tail < n
    rest[some] = minima.of(tail[some], np.full(int(some.sum()), n))
    since[key[last]] = rest
    rows = block[at]
    rows["lcp"] = np.minimum(value, LENGTH)
    # back to rank order within a byte: argsort above was stable, so it already is
    queue.push(key, rows)


def first_order(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Tuples of a shard sorted by ``right``, with common-prefix values."""
    previous = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        right, left = _grid(batch.column(0), LENGTH), _grid(batch.column(1), WINDOW)
        rows = np.zeros(n, dtype=TUPLE)
        rows["left"] = left
        rows["doc"], rows["tag"], rows["run"] = (batch.column(i).to_numpy() for i in (2, 3, 4))
        _, high, more = unpack(rows["run"])
        rows["high"], rows["low"] = high, high - more
        shifted = np.concatenate([right[:1] if previous is None else previous, right[:-1]])
        differ = shifted != right
        rows["lcp"] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        if previous is None:
            rows["lcp"][0] = 0
        previous = right[-1:].copy()
        yield rows


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """The column's byte strings as rows, padded with zeros."""
    joined = b"".join([b.ljust(width, b"\0") for b in column.to_pylist()])
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, width)


def _shards(around: DataFrame) -> DataFrame:
    """``doc, tag, start``: the windows of the compared runs that a smaller document holds."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        blocks = first_order(batches)
        for distance in range(WINDOW):
            queue = Queue() if distance + 1 < WINDOW else None
            for rows in induce(blocks, distance, queue):
                anchor, _, _ = unpack(rows["run"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc"].copy()), pa.array(rows["tag"].copy()), pa.array(anchor - distance)],
                    names=["doc", "tag", "start"])
            if queue is not None:
                blocks = queue.drain()

    tuples = around.where("window is null").select("right", "left", "doc", "tag", "run")
    return (tuples.repartition(F.substring("right", 1, K)).sortWithinPartitions("right")
            .mapInArrow(run, "doc long, tag long, start long"))


def spans(docs: DataFrame, tag, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, tag, spans array<long>``: repeated strings as ``start << 32 | length``, overlapping and unsorted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), tag.alias("tag"), F.col(f"`{text}`").alias("text"))
    hot = scratch.write(_hot(tagged, parts), "hot")
    compared = scratch.write(_compare(_runs_of(tagged), hot, parts), "compared")
    scratch.release()
    around = scratch.write(_around(_with_text(tagged, compared.where("open"))), "around")
    scratch.release()
    found = scratch.write(_shards(around).unionByName(_windows(around)), "found")
    scratch.drop("around", "hot")
    scratch.release()
    run = F.col("run")
    anchor, left, more = F.shiftright(run, 12), F.shiftright(run, 6).bitwiseAND(63), run.bitwiseAND(63)
    settled = compared.where("not open").select(
        "doc", "tag", (F.shiftleft(anchor - left, 32) + more + LENGTH).alias("span"))
    partial = found.select("doc", "tag", (F.shiftleft("start", 32) + LENGTH).alias("span"))
    return settled.unionByName(partial).groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))


def merged(packed: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of packed spans; touching ones are one run."""
    out: list[list[int]] = []
    for p in sorted(packed or ()):
        start, end = p >> 32, (p >> 32) + (p & 0xFFFFFFFF)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cut(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, end in removed:
        kept.append(raw[at:start])
        at = end
    kept.append(raw[at:])
    return b"".join(kept)


def _with_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All columns of ``docs`` and ``_spans``."""
    tag = _tag(docs, doc_id, text)
    found = spans(docs, tag, doc_id, text).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"),
                                                  F.col("spans").alias("_spans"))
    return (docs.join(found, (F.col(f"`{doc_id}`") == F.col("_doc")) & (tag == F.col("_tag")), "left")
            .drop("_doc", "_tag"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    joined = _with_spans(narrow(docs, doc_id=doc_id, text=text), "doc_id", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, digests = [], [], [], []
            for raw, packed in zip(_raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                removed = merged(packed)
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in removed))
                counts.append(len(removed))
                digests.append(hashlib.sha256(cut(raw, removed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, type=pa.int64()) for x in (sizes, gone, counts)], pa.array(digests)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", "text", "_spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, without the repeated bytes.

    A character of which some bytes went goes whole; documents left without a
    word are dropped if bytes of theirs were removed.
    """
    joined = _with_spans(docs, doc_id, text)
    at, names = docs.columns.index(text), docs.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for raw, packed in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if packed:
                    left = cut(raw.encode("utf-8", "replace"), merged(packed)).decode("utf-8", "ignore")
                    keep.append(bool(left.strip()))
                    out.append(left)
                else:
                    keep.append(True)
                    out.append(raw)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(out, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, type=pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
