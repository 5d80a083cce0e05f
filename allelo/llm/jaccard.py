"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word shingles.  Sets
fall in size bands whose ends are the threshold apart, so linked sets lie in
one band or in neighbours; every set takes part under its own band and the one
below.  Under a band two linked sets differ in at most ``k`` shingles.

Signatures: the hash domain is cut in ``n1 = k div 2 + 1 + slack`` first-level
parts of ``n2`` (2 or 3) second-level pieces each.  Two sets that differ in at
most ``k`` shingles have ``1 + slack`` parts with at most one difference;
enumerating the subsets of ``n2 - 1`` pieces of every part, one of them is the
same in both for each of these parts, and is their shared signature.  A set
with at most ``slack`` empty subsets leaves those out, which keeps the
guarantee; others keep them.  With ``e`` empty subsets a set shares at least
``1 + slack - e`` signatures with a linked one; classes that share fewer are out.

Copies with equal sets are one class from the start: a task signs a class once.  Signatures that two or
more classes share give candidates, and only connectivity is asked for:

1. every class is compared with the smallest class of each signature it holds,
   links are verified on whole sets and components are formed;
2. what is left are pairs across components under a signature; those that may
   link are verified too, and components are formed for good.

Before sets are compared, a parity sketch of them (each differing shingle flips
one of its bits, so sketches differ in no more bits than the sets in shingles)
drops pairs that cannot link, in step 2 inside the join.  Whole sets are made
again from the texts of the classes that are left, a small part of all.

So a group of copies costs a number of rows in proportion to its size, and
no link between different texts is lost.

Defined results: null text or text without words has an empty set, links with
nothing and is a component of its own (its doc_id); equal sets are one
component even where their rows repeat an id; a null id never names a
component unless all its component's ids are null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, narrow

SHINGLE, NUMERATOR, DENOMINATOR = 4, 85, 100
SKETCH = 16  # words of 64 bits
FIRST = 4

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS: dict[bytes, int] = {}
_WORDS_MOST = 200_000
BROADCAST_IDS = 500_000  # classes (24 bytes each) that travel to the texts; more meet them in a shuffle
SEEN_MOST = 1_000_000  # classes that a task remembers having signed; more only cost repeated rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, through a bounded cache."""
    if len(_WORDS) > _WORDS_MOST:
        _WORDS.clear()
    out = []
    for w in words:
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; one for the whole sequence if it is shorter than a shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(words)
    n = max(len(w) - size + 1, 1)
    h = np.full(n, 0x9E3779B97F4A7C15 + min(len(w), size), dtype=np.uint64)
    for i in range(min(size, len(w))):
        h = h * _U(0xD6E8FEB86659FD93) + w[i: i + n]
    return np.unique(mix(h))


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = np.array([int(mix(s + _U(0x632BE59BD9B4E019)).sum(dtype=np.uint64)) ^ len(s)], dtype=np.uint64)
    return int(mix(total + _U(0x9E3779B97F4A7C15)).view(np.int64)[0])


@lru_cache(maxsize=None)
def bands(numerator: int, denominator: int, largest: int = 1 << 40) -> list[int]:
    """Upper ends of the size bands."""
    ends, low = [], 1
    while low < largest:
        ends.append(low * denominator // numerator)
        low = ends[-1] + 1
    return ends


@lru_cache(maxsize=512)
def parts_of(band: int, numerator: int, denominator: int) -> tuple[int, int, np.ndarray]:
    """(slack, pieces a part, lower hash ends of the pieces) under a band."""
    ends = bands(numerator, denominator)
    k = ends[band] * (denominator - numerator) // numerator
    least = ends[band - 1] + 1 if band else 1
    cuts = 2 if 5 * (denominator - numerator) <= numerator else 3  # larger subsets where thresholds are low
    slack = 0
    for _ in range(40 if k else 0):  # enough for the subsets that the band's smallest sets leave empty, as a rule
        parts = k // 2 + 1 + slack
        empty = parts * cuts * math.exp(-least * (cuts - 1) / (parts * cuts))
        enough = math.ceil(empty + 3 * math.sqrt(empty) + 1)
        if enough <= slack:
            break
        if enough > k // 2:  # more parts leave still more of them empty
            slack = 3 + k // 50
            break
        slack = enough
    pieces = (k // 2 + 1 + slack) * cuts
    return slack, cuts, (np.arange(pieces, dtype=object) * (1 << 64) // pieces).astype(np.uint64)


def _subsets(s: np.ndarray, numerator: int, denominator: int) -> Iterator[tuple]:
    """Under each of a set's bands: (band, slack, pieces a part, piece ends in the set, subsets that are not empty)."""
    own = int(np.searchsorted(bands(numerator, denominator), len(s)))
    for band in sorted({own, max(own - 1, 0)}):
        slack, cuts, ends = parts_of(band, numerator, denominator)
        at = np.append(np.searchsorted(s, ends), len(s))
        count = np.diff(at).reshape(-1, cuts)
        yield band, slack, cuts, at, ((count.sum(axis=1)[:, None] - count) > 0).reshape(-1)


def shared_least(s: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> list[int]:
    """How many signatures of an even and of an odd band a linked set shares at least (0: no such band)."""
    least = [0, 0]
    for band, slack, _, _, full in _subsets(s, numerator, denominator):
        least[band & 1] = max(1 + slack - (len(full) - int(full.sum())), 1)
    return least


def signatures(s: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> np.ndarray:
    """The PartEnum signatures of a non-empty set (sorted 64-bit hashes), under its two bands.

    A signature's lowest bit is its band's parity.
    """
    sums = np.zeros(len(s) + 1, dtype=np.uint64)
    np.cumsum(mix(s + _U(0xA0761D6478BD642F)), out=sums[1:])
    out = []
    for band, slack, cuts, at, full in _subsets(s, numerator, denominator):
        content = (sums[at[1:]] - sums[at[:-1]]).reshape(-1, cuts)
        # every subset of a part's pieces that leaves one piece out
        subsets = (content.sum(axis=1, dtype=np.uint64)[:, None] - content).reshape(-1)
        if len(full) - int(full.sum()) > slack:
            full = np.ones(len(full), dtype=bool)
        name = np.flatnonzero(full).astype(np.uint64)
        sig = mix(subsets[full] * _U(0xE7037ED1A0B428DB) + name * _U(0x8EBC6AF09C88C6E3) + _U(band + 1))
        out.append(sig & ~_U(1) | _U(band & 1))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of ``64 * SKETCH`` hash buckets, as words."""
    at = mix(s + _U(0x589965CC75374CC3)) >> _U(54)  # 10 bits: 1024 buckets
    odd = (np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


_LONGS = pa.list_(pa.int64())


def _fresh(texts: list, size: int, seen: set[int]) -> Iterator[tuple[np.ndarray, int | None, bool]]:
    """(set, class, whether this task meets the class for the first time) of every text."""
    for text in texts:
        s = shingle_set(text, size)
        c = class_of(s) if len(s) else None
        first = c is not None and c not in seen
        if first:
            if len(seen) >= SEEN_MOST:
                seen.clear()
            seen.add(c)
        yield s, c, first


def _members(docs: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """``doc_id, t, n, c, sketch, least`` of every row of ``docs(doc_id, t, text)``.

    A class that a task has met before comes without sketch again.
    """
    none = np.zeros(0, dtype=np.int64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ns, cs, sketches, least = [], [], [], []
            for s, c, first in _fresh(batch.column(2).to_pylist(), size, seen):
                ns.append(len(s))
                cs.append(c)
                sketches.append(sketch(s) if first else none)
                least.append(shared_least(s, numerator, denominator) if first else [0, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, type=pa.int64()), pa.array(cs, type=pa.int64()),
                 _lists(sketches), pa.array(least, type=pa.list_(pa.int32()))],
                names=["doc_id", "t", "n", "c", "sketch", "least"])
        _WORDS.clear()  # a worker serves other operators after this task

    return docs.mapInArrow(run, "doc_id long, t long, n long, c long, sketch array<long>, least array<int>")


def _signed(docs: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """``sig, c``: the signatures of every class that a task holds, once.

    A large group of copies so has about as many signed rows as there are tasks.  Signatures go
    straight into the exchange: written first, they would take as much disk again.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                sigs, cs = [], []
                for s, c, first in _fresh(batch.column(0).to_pylist(), size, seen):
                    if first:
                        sigs.append(signatures(s, numerator, denominator).view(np.int64))
                        cs.append(np.full(len(sigs[-1]), c, dtype=np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(cs))],
                                                     names=["sig", "c"])
        _WORDS.clear()

    return docs.select("text").mapInArrow(run, "sig long, c long")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``c, items`` from ``c, text`` where the text is of class ``c``."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cs, items = [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, size)
                if len(s) and class_of(s) == c:  # another text of the same hash is another class
                    cs.append(c)
                    items.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cs, type=pa.int64()), _lists(items)], names=["c", "items"])

    return texts.mapInArrow(run, "c long, items array<long>")


def links(n_a: Column, n_b: Column, both: Column, numerator: int, denominator: int) -> Column:
    """Whether ``denominator * intersection >= numerator * union``, in whole numbers."""
    return denominator * both >= numerator * (n_a + n_b - both)


class Join:
    """One run of the join over a documents table."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, numerator: int = NUMERATOR,
                 denominator: int = DENOMINATOR, doc_id: str = "doc_id", text: str = "text"):
        self.docs = narrow(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("t"), "text")
        self.size, self.num, self.den = size, numerator, denominator
        self.scratch = Scratch(docs.sparkSession, "jaccard")

    def classes(self) -> DataFrame:
        """``doc_id, n, c, component``: the class of every document, and the component's smallest doc_id."""
        scratch = self.scratch
        every = scratch.write(_members(self.docs, self.size, self.num, self.den), "members")
        members = every.select("doc_id", "n", "c")
        held = scratch.write(self.held(_signed(self.docs, self.size, self.num, self.den)), "held")
        scratch.release()
        shared = scratch.write(self.shared(held, every), "shared")
        about = scratch.write(self.about(every, shared), "about")
        scratch.drop("held")
        scratch.release()
        found = scratch.write(self.verified(self.first_pairs(shared), about, "1"), "links1")
        label = scratch.write(components(found, scratch, "a"), "label1")
        scratch.release()
        found = scratch.write(found.unionByName(self.verified(self.last_pairs(shared, label, about), about, "2")), "links2")
        return named(members, components(found, scratch, "b"))

    def held(self, signed: DataFrame) -> DataFrame:
        """``sig, c``: the classes of every signature that two or more hold."""
        per = Window.partitionBy("sig")
        return (signed.withColumn("low", F.min("c").over(per)).withColumn("high", F.max("c").over(per))
                .where("low < high").select("sig", "c").distinct())

    def shared(self, held: DataFrame, every: DataFrame) -> DataFrame:
        """``sig, c, low``: the same without classes that share fewer signatures than a linked one would."""
        odd = F.col("sig").bitwiseAND(1).cast("int")
        least = every.groupBy("c").agg(F.max("least").alias("least"))
        enough = (held.groupBy("c", odd.alias("odd")).agg(F.count("*").alias("k")).join(least, "c")
                  .where(F.col("k") >= F.element_at("least", F.col("odd") + 1)).select("c", "odd"))
        per = Window.partitionBy("sig")
        return (held.withColumn("odd", odd).join(enough, ["c", "odd"], "left_semi")
                .withColumn("low", F.min("c").over(per)).withColumn("high", F.max("c").over(per))
                .where("low < high").select("sig", "c", "low"))

    def about(self, every: DataFrame, shared: DataFrame) -> DataFrame:
        """``c, n, doc_id, t, s0..``: a document, its text's hash and the sketch of every class with candidates."""
        wanted = shared.select("c").distinct()
        one = every.where(F.size("sketch") > 0).join(wanted, "c", "left_semi").groupBy("c").agg(
            F.min_by(F.struct("doc_id", "t", "n", "sketch"), F.coalesce(F.col("doc_id"), F.lit(1 << 62))).alias("x"))
        return one.select("c", "x.n", "x.doc_id", "x.t", *[F.col("x.sketch")[i].alias(f"s{i}") for i in range(SKETCH)])

    def sets(self, about: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """``c, items`` of the classes in ``pairs``, from one document's text each."""
        wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        ids = self.scratch.write(about.join(wanted, "c", "left_semi").select(
            "c", F.col("doc_id").alias("id"), F.col("t").alias("hash")), f"ids{name}")
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        # the hash tells texts of one id, or of none, apart
        texts = self.docs.join(side, (F.col("t") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("c", "text")
        return _sets(texts, self.size).dropDuplicates(["c"])

    def near(self, left: str, right: str, words: list[str]) -> Column:
        """Whether the sketches allow a link: differing bits against the most shingles that may differ."""
        bits = [F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}"))) for w in words]
        total = F.col(f"{left}.n") + F.col(f"{right}.n")
        return (self.num + self.den) * sum(bits[1:], bits[0]) <= (self.den - self.num) * total

    def first_pairs(self, shared: DataFrame) -> DataFrame:
        return shared.where("low < c").select(F.col("low").alias("a"), F.col("c").alias("b")).distinct()

    def labelled(self, shared: DataFrame, label: DataFrame) -> DataFrame:
        """The shared signatures whose classes are not all in one component: ``sig, c, comp``."""
        per = Window.partitionBy("sig")
        return (shared.join(label, "c", "left").select("sig", "c", F.coalesce("comp", "c").alias("comp"))
                .withColumn("lo", F.min("comp").over(per)).withColumn("hi", F.max("comp").over(per))
                .where("lo < hi").select("sig", "c", "comp", "lo"))

    def last_pairs(self, shared: DataFrame, label: DataFrame, about: DataFrame) -> DataFrame:
        """All pairs across components under a signature whose sketches allow a link.

        A pair is left out where a smaller signature brings it too, as far as the
        ``FIRST`` smallest signatures of both classes tell: most pairs come once.
        """
        rows = self.labelled(shared, label)
        few = rows.groupBy("c").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST).alias("few"))
        # folding a sketch in half joins buckets in pairs: still no more bits than differing shingles
        half = [F.col(f"s{i}").bitwiseXOR(F.col(f"s{i + SKETCH // 2}")).alias(f"h{i}") for i in range(SKETCH // 2)]
        rows = (rows.join(few.join(about.select("c", "n", *half), "c"), "c")
                .withColumn("smaller", F.filter("few", lambda x: x < F.col("sig"))).drop("few", "lo"))
        a, b = rows.alias("a"), rows.alias("b")
        pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.c") < F.col("b.c"))
                       & (F.col("a.comp") != F.col("b.comp")) & self.near("a", "b", [f"h{i}" for i in range(SKETCH // 2)])
                       & ~F.arrays_overlap(F.col("a.smaller"), F.col("b.smaller")))
        return pairs.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()

    def verified(self, pairs: DataFrame, about: DataFrame, name: str) -> DataFrame:
        """The pairs ``a, b`` that link: the sketches first, then the whole sets."""
        facts = about.drop("doc_id", "t")
        close = (pairs.join(facts.withColumnRenamed("c", "a").alias("x"), "a")
                 .join(facts.withColumnRenamed("c", "b").alias("y"), "b").where(self.near("x", "y", [f"s{i}" for i in range(SKETCH)]))
                 .select("a", "b", F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")))
        close = self.scratch.write(close, f"close{name}")
        sets = self.scratch.write(self.sets(about, close, name), f"sets{name}")
        both = F.size(F.array_intersect("items_a", "items_b"))
        return (close.join(sets.select(F.col("c").alias("b"), F.col("items").alias("items_b")), "b")
                .join(sets.select(F.col("c").alias("a"), F.col("items").alias("items_a")), "a")
                .where(links(F.col("n_a"), F.col("n_b"), both, self.num, self.den)).select("a", "b"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``c, comp``: the smallest node reachable from every node of ``edges(a, b)``.

    Alternating large-star and small-star steps: every node points at the
    smallest node known to be connected with it, until nothing changes.  Rows
    stay in proportion to the edges; each step is a written table.
    """
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    step = 0
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = scratch.write(small, f"cc-{name}-{step}")
        if step:
            scratch.drop(f"cc-{name}-{step - 1}")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            break
        before, step = now, step + 1
    return (state.select(F.col("u").alias("c"), F.col("v").alias("comp"))
            .unionByName(state.select(F.col("v").alias("c"), F.col("v").alias("comp")).distinct()))


def named(members: DataFrame, label: DataFrame) -> DataFrame:
    """Name every component by its smallest doc_id; a class without links is a component of its own."""
    comps = members.groupBy("c").agg(F.min("doc_id").alias("low")).where("c is not null")
    comps = comps.join(label, "c", "left").select("c", "low", F.coalesce("comp", "c").alias("comp"))
    lowest = comps.groupBy("comp").agg(F.min("low").alias("component"))
    names = comps.join(lowest, "comp").select("c", "component")
    return (members.join(names, "c", "left")
            .select("doc_id", "n", "c", F.coalesce("component", "doc_id").alias("component")))


def join(docs: DataFrame, size: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, c, component`` of every document: set size, class and component."""
    return Join(docs, size, numerator, denominator, doc_id, text).classes()


def representatives(docs: DataFrame, size: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of one document a component: the one with the smallest id.

    Repeated rows stay once; rows with a null id stay.
    """
    kept = (join(docs, size, numerator, denominator, doc_id, text).where("doc_id = component")
            .select(F.col("doc_id").alias("_kept")).distinct())
    named = docs.join(kept, F.col(f"`{doc_id}`") == F.col("_kept"), "left_semi").dropDuplicates([doc_id, text])
    return named.unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
