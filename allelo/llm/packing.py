"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's ids are its tokens and one closing id.  Longer ones than the
capacity are cut into pieces of the capacity.  Pieces above half the capacity
can never share a sequence, so each opens its own.  The others are packed by
bulk-synchronous best fit.  One round:

1. open gaps and unplaced pieces are range-sorted together, largest first, a
   gap before a piece of its size;
2. every range is swept: a piece takes its successor, the smallest gap seen
   that it fits, and the gap shrinks.  What a range cannot match is a run of
   pieces followed by a run of gaps;
3. the runs, one summary row a range, are swept in the same way on the driver;
   conflicts are resolved by rank: piece ``k`` of a run takes gap ``top - k div c``
   of the run it meets, where ``c`` is how many pieces of that run surely fit
   into one such gap;
4. gaps shrink by what they took, and the round repeats with the rest.

When nothing fits any more, just enough empty sequences for the words left are
opened.  Rows of a round are written to a shared table, so a lost executor
costs one stage.  Ranges hold ``RANGE_ROWS`` rows, whatever the input's size.

Defined results: null or empty text is the closing id alone; repeated rows are
documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, arrow_map, ids_by_number, narrow

CAPACITY = 2048
END_ID = 0
RANGE_ROWS = 100_000
CACHE_WORDS = 300_000
ROWS_WITH_IDS = 500  # rows that a task handles at once where pieces carry their ids
GROUP = 6 << 20  # characters whose words are looked up together

# white space of the tokenizer and of str.split() differ in these; from U+0300 on normal forms matter
_ODD = re.compile("[\x1c-\x1fİ̀-\U0010ffff]")
_TAIL = ".,;:!?"


def odd(text: str) -> bool:
    """Whether the word cache could fail on the text."""
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _ODD.search(text) is not None


_WORKER: dict = {}


class WordCache:
    """Ids of whole texts as little-endian 32-bit bytes, through a bounded cache of words.

    The tokenizer treats white-space separated words independently, so a text's
    ids are its words' ids in a row.  Words of letters alone are encoded many at
    a time, as each gives one run of ids up to a token that ends a word.  Texts
    with characters for which this could fail are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}  # white space at a text's ends leaves empty words
        # lower-case words of letters need no normaliser and no splitting pattern, only the bytes' characters
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.characters: dict[int, str] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Add words to the cache."""
        letters, tailed, other = set(), [], []
        for word in words:
            if word.isalpha():
                letters.add(word)
            elif (core := word.rstrip(_TAIL)).isalpha():
                tailed.append((word, core, word[len(core):]))
                letters.add(core)
            else:
                other.append(word)
        for word, coded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[word] = np.array(coded.ids, dtype="<u4").tobytes()
        fresh = [w for w in letters if w not in self.known]
        ids = self.run_of(fresh)
        ends, raw, at = 4 * (np.flatnonzero(self.ends[ids]) + 1), ids.tobytes(), 0
        for word, end in zip(fresh, ends.tolist(), strict=True):
            self.known[word] = raw[at:end]
            at = end
        for word, core, tail in tailed:
            if tail not in self.known:
                self.known[tail] = self.encode(tail)
            self.known[word] = self.known[core] + self.known[tail]

    def run_of(self, words: list[str]) -> np.ndarray:
        """Ids of lower-case words of letters, one after the other."""
        joined = " ".join(words)
        for c in set(joined) - {" "}:
            if ord(c) not in self.characters:
                self.characters[ord(c)] = self.bytes.pre_tokenize_str(c)[0][0]
        ids = self.plain.encode_batch_fast([joined.translate(self.characters)], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4")

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text; the words of about ``GROUP`` characters are looked up together, each once."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self.of(group)
                group, size = [], 0
        yield from self.of(group)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not odd(text) for text in texts]
        lowered = [text.lower() for text, p in zip(texts, plain, strict=True) if p]
        raw, cuts = ids_by_number(pc.utf8_split_whitespace(pa.array(lowered, type=pa.large_string())), self.ids_of)
        spans = itertools.pairwise(cuts)
        for text, p in zip(texts, plain, strict=True):
            a, b = next(spans) if p else (0, 0)
            yield raw[a:b] if p else self.encode(text)

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; beyond the cache's bound only these stay, with them all that is frequent."""
        if fresh := {w for w in words if w not in self.known}:
            self.learn(fresh)
        held = list(map(self.known.__getitem__, words))
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""} | dict(zip(words, held, strict=True))
        return held


def _worker(path: str) -> WordCache:
    if path not in _WORKER:
        _WORKER[path] = WordCache(path)
    return _WORKER[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``: the piece's ids as 32-bit bytes)."""
    closing = END_ID.to_bytes(4, "little")

    def run(keys, texts) -> Iterator[tuple]:
        cache = _worker(tokenizer)
        for key, ids in zip(keys, cache.many([t or "" for t in texts]), strict=True):
            ids += closing
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                cut = ids[at: at + 4 * capacity]
                yield (key, n, at // 4, len(cut) // 4, zlib.crc32(cut), *([cut] if with_ids else []))

    return arrow_map(narrow(docs, doc_id=doc_id, text=text), run,
                     "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids,
                     ROWS_WITH_IDS if with_ids else None)


_SWEEP = "tag string, seq long, gap long, item long, length long, range int, rank long"


def _sweep(frame: DataFrame) -> DataFrame:
    """Best fit within each sorted range, from the largest size to the smallest.

    ``m``: a piece placed in a gap of size ``gap``; ``i``: a piece left; ``g``: a
    gap left that any piece of a later range fits; ``u``: another gap left.
    Ranks count from the largest.
    """
    def run(batches):
        free: dict[int, list[int]] = {}  # gap size -> sequences
        sizes = 0  # bit s: free[s] is not empty
        left, where, lowest = 0, 0, 0
        for batch in batches:
            out = []
            for size, kind, key, where in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lowest = size
                if kind == 0:
                    free.setdefault(size, []).append(key)
                    sizes |= 1 << size
                    continue
                fitting = sizes >> size
                if not fitting:
                    out.append(("i", 0, 0, key, size, where, left))
                    left += 1
                    continue
                gap = size + (fitting & -fitting).bit_length() - 1
                seq = free[gap].pop()
                if not free[gap]:
                    sizes ^= 1 << gap
                out.append(("m", seq, gap, key, size, where, 0))
                if gap > size:
                    free.setdefault(gap - size, []).append(seq)
                    sizes |= 1 << gap - size
            yield _rows(out)
        out, rank = [], 0
        for gap in sorted((g for g, seqs in free.items() if seqs), reverse=True):
            for seq in free[gap]:
                out.append(("g" if gap >= lowest else "u", seq, gap, 0, 0, where, rank))
                rank += 1
        yield _rows(out)

    return frame.mapInArrow(run, _SWEEP)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["tag", "seq", "gap", "item", "length", "range", "rank"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)


def match_runs(summary: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Sweep the ranges' leftovers: rows (range, pieces, largest piece, gaps, smallest gap), any order.

    Returns (range, first piece, end piece, gap's range, top gap, pieces a gap):
    piece ``k`` of the range takes gap ``top - (k - first) div per`` of the gap's range.
    """
    stack: list[list[int]] = []  # [range, gaps left, smallest gap]
    out = []
    for where, items, largest, gaps, smallest in sorted(summary):
        at = 0
        while at < items and stack:
            source, free, gap = stack[-1]
            per = max(1, gap // max(largest, 1))
            used = min(free, -(-(items - at) // per))
            end = min(items, at + used * per)
            out.append((where, at, end, source, free - 1, per))
            at = end
            stack[-1][1] -= used
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([where, gaps, smallest])
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """``item, sequence_id, offset`` for ``items(item long unique, length long)``, lengths 1 to ``capacity``.

    ``items`` is read several times: pass a written table.
    """
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    big = items.where(F.col("length") * 2 > capacity)
    placed = [big.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = items.where(F.col("length") * 2 <= capacity).select("item", "length")
    gaps = (big.where(F.col("length") < capacity)
            .select(F.col("item").alias("seq"), (F.lit(capacity) - F.col("length")).alias("gap")))
    left, words, shortest = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.min("length")).first()
    opened, full = 0, False  # full: no piece left fits any gap left
    for turn in itertools.count():
        if not left:
            break
        gaps = gaps.where(F.col("gap") >= shortest)  # smaller ones are closed for good
        free, space = gaps.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0))).first()
        new = -(-words // capacity) if full else max(-(-(words - space) // capacity), int(not free), 0)
        gaps = gaps.unionByName(spark.range(new).select(
            (-F.col("id") - 1 - opened).alias("seq"), F.lit(capacity).cast("long").alias("gap")))
        opened += new
        ranges = -(-(left + free + new) // RANGE_ROWS)
        swept = scratch.write(_sorted_sweep(gaps, rest, ranges), f"sweep{turn}")
        summary = _by_range(swept)
        runs = match_runs([(where, items["n"], items["longest"], gaps["n"], gaps["least"])
                           for where, (items, gaps) in summary["left"].items()])
        met = swept.where("tag = 'm'")
        placed.append(met.select("item", F.col("seq").alias("sequence_id"), (F.lit(capacity) - F.col("gap")).alias("offset")))
        count, table = summary["placed"], swept
        if runs:
            table = scratch.write(_settle(spark, swept, runs, capacity), f"round{turn}")
            placed.append(table.where("tag = 'p'").select("item", F.col("seq").alias("sequence_id"), "offset"))
            count += sum(end - first for _, first, end, *_ in runs)
        rest = table.where("tag = 'i'").select("item", "length")
        gaps = table.where("tag in ('g', 'u')").select("seq", "gap")
        left, words, shortest = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.min("length")).first()
        full = ranges == 1 or not count
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def _by_range(swept: DataFrame) -> dict:
    """What a sweep left: per range its pieces and gaps (three rows a range reach the driver), and how many it placed."""
    rows = swept.groupBy("range", "tag").agg(F.count("*").alias("n"), F.max("length").alias("longest"),
                                             F.min("gap").alias("least")).collect()
    none = {"n": 0, "longest": 0, "least": 0}
    left: dict[int, list] = {}
    for r in rows:
        if r["tag"] in "ig":
            left.setdefault(r["range"], [none, none])["ig".index(r["tag"])] = r.asDict()
    return {"left": left, "placed": sum(r["n"] for r in rows if r["tag"] == "m")}


def _sorted_sweep(gaps: DataFrame, rest: DataFrame, ranges: int) -> DataFrame:
    both = (gaps.select(F.col("gap").alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("key"))
            .unionByName(rest.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("item").alias("key"))))
    order = [F.desc("size"), F.asc("kind"), F.asc("key")]
    dealt = both.repartitionByRange(ranges, *order) if ranges > 1 else both.coalesce(1)  # at most RANGE_ROWS rows
    return _sweep(dealt.sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))


def _settle(spark: SparkSession, swept: DataFrame, runs: list[tuple], capacity: int) -> DataFrame:
    """Matches between ranges (p), pieces left (i) and gaps left (g) after a round, as one table."""
    intervals = F.broadcast(spark.createDataFrame(  # at most two rows a range
        runs, "r int, first long, end long, gap_range int, top long, per long"))
    inside = (F.col("range") == F.col("r")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    aimed = (swept.where("tag = 'i'").join(intervals, inside, "left")
             .select("item", "length", "gap_range", F.expr("top - (rank - first) div per").alias("gap_rank"),
                     F.expr("(rank - first) % per").alias("turn")))
    slots = (swept.where("tag in ('g', 'u')")
             .select("seq", "gap", F.when(F.col("tag") == "g", F.col("range")).alias("gap_range"),
                     F.col("rank").alias("gap_rank")))
    taken = (aimed.where("gap_range is not null").groupBy("gap_range", "gap_rank")  # at most gap / longest pieces
             .agg(F.array_sort(F.collect_list(F.struct("turn", "item", "length"))).alias("pieces")))
    both = slots.join(taken, ["gap_range", "gap_rank"], "left")
    zero = F.lit(0).cast("long")
    took = F.coalesce(F.aggregate("pieces", zero, lambda a, x: a + x["length"]), zero)
    # every gap gives one row for what is left of it and one for each piece it took
    none = F.lit(None).cast("long")
    own = F.array(F.struct(F.lit("g").alias("tag"), none.alias("item"), none.alias("length"),
                           (F.col("gap") - took).alias("gap"), none.alias("offset")))
    before = lambda i: F.aggregate(F.slice("pieces", 1, i), zero, lambda a, x: a + x["length"])
    each = F.transform("pieces", lambda x, i: F.struct(
        F.lit("p").alias("tag"), x["item"].alias("item"), x["length"].alias("length"), none.alias("gap"),
        (F.lit(capacity) - F.col("gap") + before(i)).alias("offset")))
    rows = both.select("seq", F.explode(F.concat(own, F.coalesce(each, F.slice(own, 1, 0)))).alias("x")).select(
        "x.tag", "x.item", "x.length", "seq", "x.gap", "x.offset").where("tag = 'p' or gap > 0")
    over = aimed.where("gap_range is null").select(F.lit("i").alias("tag"), "item", "length", none.alias("seq"),
                                                   none.alias("gap"), none.alias("offset"))
    return rows.unionByName(over)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its place: the columns of ``pieces`` and ``sequence_id, offset``."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, tokenizer, capacity, with_ids, doc_id, text)
    cut = scratch.write(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    return cut.join(pack(cut.select("item", "length"), capacity, scratch), "item").drop("item")
