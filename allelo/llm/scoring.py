"""LM scoring by cross-entropy difference.

Two interpolated bigram models over one vocabulary, a target model of the good
documents and a background model of all documents, score every document by the
mean difference of their losses per token: positive scores read like the target.

The shared vocabulary is every word that all documents hold ``LEAST`` times or
more, so it grows with the corpus; rarer words are one unknown word.  Every
bigram counts.  Words are told apart by 64-bit hashes; those of the vocabulary travel with the
tasks, 8 bytes a word.  The ``HOT`` most frequent words (ties: the smaller word)
and the unknown word only decide where counting is done:

1. bigrams of two hot words, and hot words' own counts, are counted per task,
   summed by a shuffle and sent to the tasks as a table of ``(HOT + 3) ** 2`` counts;
2. all other bigrams are dealt to buckets by their cold word (the second word, or
   the first if the second is hot), one entry for each document and distinct
   bigram.  A bucket then holds every occurrence of its words and their bigrams,
   so it counts them and scores the entries at once; sums go back by document.
   A cold word is rarer than the ``HOT`` most frequent, so no bucket is hot.

A cold word goes by its place among the sorted hashes of the vocabulary, 32 bits; buckets are
ranges of places.  Entries travel as packed blocks of many, in the order of their documents, so
that what repeats within a document costs little; sums go back in blocks too, as whole multiples of
``2 ** -SUM_BITS``, so that their order does not matter.  There are as many buckets as the
corpus's tokens need.  A caller may cut the vocabulary to ``size`` words; then
nothing is dealt.

    p(w) = (c(w) + 1) / (n + V)
    p(w | v) = (c(v w) + MASS * p(w)) / (c(v) + MASS)

``V`` is the number of the vocabulary's words and 2.
Both models are matched: the same vocabulary, smoothing and order, and the
background's counts are scaled to the target's number of tokens.  A document's
own counts are taken off the models that counted it before it is scored, so
documents inside and outside the target are measured alike.

The target documents are all with ``labels.quality = 1`` outside the held-out
fold; rows that share an id are counted each.  Vocabulary and background cover
all documents.  Up to ``BROADCAST_IDS`` labelled ids travel to the texts; more
meet them in a shuffle.

Defined results: null or empty text has no tokens, null losses and score 0;
without target documents the target model is the smoothing alone; repeated
rows each give their own row; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, held_out, narrow

HOT = 1024
LEAST = 10  # a word that all documents together hold less often is the unknown word
BROADCAST_IDS = 5_000_000  # labelled ids sent to every executor at most; none is dropped
MASS = 8.0
START, UNKNOWN = 0, 1  # ids before the words': what stands before a document, and every other word
FLUSH_WORDS = 300_000  # distinct words that a counting task holds at most
GROUP_BYTES = 2 << 20  # text that is handled at a time
FLUSH_ENTRIES = 1_000_000  # entries that a dealing task holds at most
BUCKET_TOKENS = 250_000  # tokens of the corpus for each bucket
AFTER = 1 << 12  # an entry's other word is the hot word after its cold word; else the word before it
COLD = 1 << 13  # ids from here on are cold words', by their place in the vocabulary
SUM_BITS = 24
ROW_BITS = 40  # bits of a document's number within its task

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of every word of all documents."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words(text))
                if len(held) > FLUSH_WORDS:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), type=pa.binary()),
                                           pa.array(held.values(), type=pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1


def vocabulary(texts: DataFrame, size: int | None, hot: int, least: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, and the sorted ids of the vocabulary's other words (none if ``size`` cuts it)."""
    scratch = Scratch(texts.sparkSession, "scoring")
    counts = word_counts(texts)
    if size is not None:
        return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()], np.zeros(0, "i8")
    counts = scratch.write(counts.where(F.col("n") >= least), "words")
    first = [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(hot).collect()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        skip = set(first)
        for batch in batches:
            ids = [word_hash(w) for w in batch.column(0).to_pylist() if w not in skip]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64())], names=["id"])

    ids = counts.select("word").mapInArrow(run, "id long").toArrow().column("id").to_numpy()
    scratch.drop("words")
    return first, np.unique(ids)


class Ids(dict):
    """Word -> id: of the hot words, of the vocabulary's other words, else ``UNKNOWN``."""

    def __init__(self, index: dict[bytes, int], known: np.ndarray):
        super().__init__(index)
        self.known, self.most = known, len(index) + FLUSH_WORDS

    def of(self, words: list[bytes]) -> np.ndarray:
        """Ids of distinct words, -1 of the empty one; those not met before are looked up at once."""
        found = np.fromiter(map(self.get, words, repeat(-2)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(found == -2)
        if not len(new):
            return found
        fresh = [words[i] for i in new.tolist()]
        ids = np.full(len(new), UNKNOWN)
        if len(self.known):
            hashes = np.fromiter(map(word_hash, fresh), dtype=np.int64, count=len(fresh))
            at = np.minimum(self.known.searchsorted(hashes), len(self.known) - 1)
            ids = np.where(self.known[at] == hashes, COLD + at, UNKNOWN)
        ids[[not w for w in fresh]] = -1
        found[new] = ids
        room = max(self.most - len(self), 0)
        self.update(zip(fresh[:room], ids[:room].tolist()))
        return found


class Counts:
    """Word, context and bigram counts of one model over ``size`` ids."""

    def __init__(self, size: int):
        self.size = size
        self.words, self.contexts = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.pairs = np.zeros(size * size, dtype=np.int64)

    def add(self, ids: np.ndarray, before: np.ndarray) -> None:
        """Count words that stand after the words ``before``."""
        self.words += np.bincount(ids, minlength=self.size)
        self.contexts += np.bincount(before, minlength=self.size)
        self.pairs += np.bincount(before * self.size + ids, minlength=self.size * self.size)


def previous(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], ids[:-1]])


_BLANKS = bytes(32 if chr(c).isspace() and c < 128 and c not in (28, 29, 30, 31) else x for c, x in enumerate(_LOWER))


def encode(texts: list[str | None], index: Ids) -> list[np.ndarray]:
    """Ids of every text's words; Arrow numbers the words, so each distinct one is looked up once."""
    raw = [(t or "").encode("utf-8", "replace").translate(_BLANKS) for t in texts]
    split = pc.split_pattern(pa.array(raw, type=pa.large_binary()), " ")
    encoded = pc.list_flatten(split).dictionary_encode()
    known = index.of(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())
    ids = known[encoded.indices.to_numpy()] if len(known) else np.zeros(0, dtype=np.int64)
    real = ids >= 0  # blanks in a row leave empty words
    offsets = split.offsets.to_numpy()
    return np.split(ids[real], np.r_[0, np.cumsum(real)][offsets[1:-1] - offsets[0]])


def groups_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``GROUP_BYTES`` of text in the first column that holds text."""
    text = next(c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type))
    sizes = np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(float))
    part = np.cumsum(sizes) // GROUP_BYTES
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def gather(texts: DataFrame, vocab: list[bytes], known: np.ndarray) -> DataFrame:
    """``kind, bucket, n, target_n`` summed over all ``marked`` documents; cold words count as one, the last id."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        index, cold = Ids({w: i + 2 for i, w in enumerate(vocab)}, shared.value), len(vocab) + 2
        every, target = Counts(cold + 1), Counts(cold + 1)
        for batch in batches:
            for group in groups_of(batch):
                docs = encode(group.column(0).to_pylist(), index)
                sizes = np.array([len(ids) for ids in docs])
                if not sizes.sum():
                    continue
                ids = np.minimum(np.concatenate(docs), cold)
                before = previous(ids)
                before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
                good = np.repeat(group.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
                every.add(ids, before)
                target.add(ids[good], before[good])
        for kind, name in enumerate(("words", "contexts", "pairs")):
            a, b = getattr(every, name), getattr(target, name)
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(a[at]),
                 pa.array(b[at])], names=["kind", "bucket", "n", "target_n"])

    rows = texts.select("text", "target").mapInArrow(run, "kind int, bucket int, n long, target_n long")
    return rows.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("target_n").alias("target_n"))


def marked(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``doc_id, text, target`` of all documents; every labelled id outside the held-out fold is the target."""
    good = (narrow(labels, doc_id="doc_id", quality="quality").where("quality = 1 and doc_id is not null")
            .where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("good")).distinct())
    chosen = F.broadcast(good) if good.count() <= broadcast_ids else good.hint("merge")
    return (narrow(docs, doc_id=doc_id, text=text).join(chosen, F.col("doc_id") == F.col("good"), "left")
            .select("doc_id", "text", F.col("good").isNotNull().alias("target")))


class Models:
    """The hot words with the background and the target counts, and the ids of the ``known`` cold words."""

    def __init__(self, vocab: list[bytes], known: np.ndarray, background: Counts, target: Counts):
        self.index = {w: i + 2 for i, w in enumerate(vocab)}
        self.known, self.background, self.target = known, background, target
        self.n, self.n_target = int(background.words.sum()), int(target.words.sum())
        self.scale = self.n_target / self.n if self.n else 1.0
        self.size = len(vocab) + len(known) + 2

    def pair_logs(self, n, k, kw, good, word, pair, target_word, target_pair) -> np.ndarray:
        """(target, background) sums of log2(c(v w) + MASS * p(w)) over a document's ``k`` equal bigrams.

        The document's own counts, ``k`` of the bigram, ``kw`` of the word and
        ``n`` of all, come off; the background is scaled to the target's size,
        so that smoothing weighs alike.
        """
        def logs(total, c_word, c_pair, own, scale):
            p = (scale * (c_word - own * kw) + 1) / (scale * (total - own * n) + self.size)
            return k * np.log2(scale * (c_pair - own * k) + MASS * p)

        return np.stack([logs(self.n_target, target_word, target_pair, good, 1.0),
                         logs(self.n, word, pair, 1, self.scale)])

    def context_logs(self, k, good, context, target_context) -> np.ndarray:
        """(target, background) sums of log2(c(v) + MASS) over a document's ``k`` words after v."""
        return np.stack([k * np.log2(target_context - good * k + MASS),
                         k * np.log2(self.scale * (context - k) + MASS)])


def fit(texts: DataFrame, size: int | None = None, hot: int = HOT, least: int = LEAST) -> Models:
    """The models of ``marked`` documents over the words held ``least`` times, or only the ``size`` most frequent.

    The driver gets an id a word, and a row a word and bigram of the hot words at most.
    """
    vocab, known = vocabulary(texts, size, hot, least)
    rows = gather(texts, vocab, known).toArrow()
    kind, bucket = rows.column("kind").to_numpy(), rows.column("bucket").to_numpy()
    models = []
    for column in ("n", "target_n"):
        counts, n = Counts(len(vocab) + 3), rows.column(column).to_numpy()
        for k, name in enumerate(("words", "contexts", "pairs")):
            getattr(counts, name)[bucket[kind == k]] = n[kind == k]
        models.append(counts)
    return Models(vocab, known, *models)


def joined(*keys: np.ndarray) -> tuple[np.ndarray, list[int]] | None:
    """Whole numbers from 0 on as one, the first key highest, and the bits of each; None if 63 do not hold them."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return None
    out = keys[0].astype(np.int64)
    for key, b in zip(keys[1:], bits[1:], strict=True):
        out = out << b | key
    return out, bits


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, the first most, and in that order the number of each place's group)."""
    n = len(keys[0])
    one = joined(*[k - k.min() if n else k for k in keys], np.arange(n))
    if one is None:
        order = np.lexsort(keys[::-1])
    else:  # a sort of numbers that end in their place is many times faster
        order = np.sort(one[0]) & (1 << one[1][-1]) - 1
    new = np.zeros(n, dtype=bool)
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, np.cumsum(new)


def counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(the distinct combinations of keys from 0 on, sorted, the first key most, and how often each occurs)."""
    one = joined(*keys)
    if one is None:
        order, group = groups(*keys)
        first = order[np.flatnonzero(np.diff(group, prepend=-1))]
        return [k[first] for k in keys], np.bincount(group)
    every = np.sort(one[0])
    start = np.flatnonzero(np.diff(every, prepend=-1))
    left, out = every[start], []
    for b in reversed(one[1]):
        out.append(left & (1 << b) - 1)
        left = left >> b
    return out[::-1], np.diff(start, append=len(every))


ENTRY = [("uid", "u4"), ("word", "u4"), ("other", "u4"), ("n", "u4"), ("k", "u4"), ("kw", "u4"), ("flags", "u1")]
SUM = [("uid", "u4"), ("target", "i8"), ("background", "i8")]
GOOD, LAST = 1, 2  # flags: the target counted the document; the cold word is its last


def packed(columns: list[np.ndarray], kinds: list[tuple]) -> bytes:
    """Rows sorted by their first column in one block: each column's bytes by their place in the number, compressed.

    The first column is stored as steps from row to row.
    """
    columns = [np.diff(columns[0], prepend=0), *columns[1:]]
    raw = b"".join(np.ascontiguousarray(c, dtype=t).view("u1").reshape(len(c), -1).T.tobytes()
                   for c, (_, t) in zip(columns, kinds, strict=True))
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, rows: int, kinds: list[tuple]) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for _, t in kinds]
    raw = np.frombuffer(pa.decompress(data, rows * sum(widths), codec="zstd", asbytes=True), dtype="u1")
    out, at = [], 0
    for width, (_, t) in zip(widths, kinds, strict=True):
        column = np.ascontiguousarray(raw[at: at + rows * width].reshape(width, rows).T).view(t).ravel()
        out.append(column.astype(np.int64))
        at += rows * width
    return [np.cumsum(out[0]), *out[1:]]


def of_group(m: Models, docs: list[tuple[int, np.ndarray, bool]]):
    """(target, background) sums of the hot part of each document, and the entries of the rest."""
    n = np.array([len(ids) for _, ids, _ in docs])
    if not n.sum():
        return np.zeros((2, len(docs))), [np.zeros(0, dtype=np.int64) for _ in ENTRY]
    uid, good = np.array([u for u, _, _ in docs]), np.array([g for _, _, g in docs]).astype(np.int64)
    word = np.concatenate([ids for _, ids, _ in docs])
    before = np.concatenate([previous(ids) if len(ids) else ids for _, ids, _ in docs])
    doc = np.repeat(np.arange(len(docs)), n)
    b, t, side = m.background, m.target, m.background.size
    sums = np.zeros((2, len(docs)))

    def add(at, logs):
        for i in (0, 1):
            sums[i] += np.bincount(at, logs[i], minlength=len(docs))

    hot = before < COLD
    (at, v), k = counted(doc[hot], before[hot])  # hot contexts
    add(at, m.context_logs(k, good[at], b.contexts[v], t.contexts[v]))

    (at, w, v), k = counted(doc, word, before)  # distinct bigrams
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (w[1:] != w[:-1])])
    same = np.cumsum(new) - 1
    kw = np.bincount(same, k).astype(np.int64)[same]
    hot = (w < COLD) & (v < COLD)
    a, x, y = at[hot], w[hot], v[hot] * side + w[hot]
    add(a, -m.pair_logs(n[a], k[hot], kw[hot], good[a], b.words[x], b.pairs[y], t.words[x], t.pairs[y]))

    ends = np.where(n > 0, word[np.minimum(np.cumsum(n), len(word)) - 1], -1)
    after = w < COLD  # the hot word after a cold one; else the cold word after any
    key = np.where(after, v, w)
    flags = good[at] * GOOD + (ends[at] == key) * LAST
    return sums, [c[~hot] for c in (uid[at], key, np.where(after, w + AFTER, v), n[at], k, kw, flags)]


def of_bucket(m: Models, uid, word, other, n, k, kw, flags) -> tuple[np.ndarray, np.ndarray]:
    """(document, (target, background) sums) of a bucket that holds every entry of its words."""
    order, pair = groups(word, other)
    word, other, uid, n, k, kw, flags = (c[order] for c in (word, other, uid, n, k, kw, flags))
    good = flags & GOOD
    cold = np.cumsum(np.concatenate([[False], word[1:] != word[:-1]]))
    after = (other >= AFTER) & (other < COLD)
    total = lambda at, x: np.bincount(at, x).astype(np.int64)  # noqa: E731  counts are whole and below 2 ** 53
    c_pair, t_pair = total(pair, k)[pair], total(pair, k * good)[pair]
    c_word, t_word = total(cold, k * ~after), total(cold, k * good * ~after)
    hot = np.where(after, other - AFTER, 0)
    own, target_own = (np.where(after, x.words[hot], y[cold]) for x, y in ((m.background, c_word), (m.target, t_word)))
    logs = -m.pair_logs(n, k, kw, good, own, c_pair, target_own, t_pair)

    docs, place = np.unique(uid, return_inverse=True)
    at = np.flatnonzero(~after)  # every document of a cold word has an entry of what stands before it
    order, group = groups(cold[at], place[at])
    first = at[order[np.flatnonzero(np.diff(group, prepend=-1))]]
    last = (flags[first] & LAST) // LAST
    contexts, t_contexts = ((x - np.bincount(cold[first], last * y, minlength=len(x)).astype(np.int64))[cold[first]]
                            for x, y in ((c_word, 1), (t_word, good[first])))
    more = m.context_logs(kw[first] - last, good[first], contexts, t_contexts)

    at = np.concatenate([place, place[first]])
    both = np.concatenate([logs, more], axis=1)
    return docs, np.stack([np.bincount(at, x, minlength=len(docs)) for x in both])


BLOCKS = "bucket int, part long, rows int, data binary, uid long, doc_id long, n_tokens long, target long, background long"
_NAMES = [c.strip().split()[0] for c in BLOCKS.split(",")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 5]


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of ``BLOCKS`` with nulls in the columns that are not given."""
    return pa.RecordBatch.from_arrays(
        [columns[c].cast(t) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], type=t) if c in columns
         else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _fixed(sums: np.ndarray) -> np.ndarray:
    """Sums as whole multiples of ``2 ** -SUM_BITS``."""
    return np.rint(sums * (1 << SUM_BITS)).astype(np.int64)


def _blocks(columns: list[np.ndarray], by: np.ndarray, kinds: list[tuple]) -> Iterator[tuple[int, int, int, bytes]]:
    """(first place, end, value of ``by``, data) of the rows of each value, sorted by their first column."""
    order = groups(by, columns[0])[0]
    columns, by = [c[order] for c in columns], by[order]
    first = np.flatnonzero(np.diff(by, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(by)], strict=True):
        yield a, b, int(by[a]), packed([c[a:b] for c in columns], kinds)


def score(texts: DataFrame, models: Models, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every ``marked`` document."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(models)  # the hot words' counts and 8 bytes a word
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), models.n // (4 * bucket_tokens) + 1)
    buckets, cold_words = 4 * parts, max(len(models.known), 1)

    def deal(batches) -> Iterator[pa.RecordBatch]:
        """A row for each document, and blocks of entries by bucket."""
        m, part, row, held, entries = shared.value, TaskContext.get().partitionId(), 0, [], 0
        index = Ids(m.index, m.known)
        for whole in batches:
            for batch in groups_of(whole):
                group = [(row + i, ids, good) for i, (ids, good) in enumerate(zip(
                    encode(batch.column(1).to_pylist(), index), batch.column(2).to_pylist(), strict=True))]
                row += len(group)
                sums, more = of_group(m, group)
                fixed = _fixed(sums)
                yield _rows(len(group), bucket=[g[0] % buckets for g in group], part=[part] * len(group),
                            uid=[g[0] for g in group], doc_id=batch.column(0), n_tokens=[len(g[1]) for g in group],
                            target=fixed[0], background=fixed[1])
                held.append(more)
                entries += len(more[0])
                if entries >= FLUSH_ENTRIES:
                    yield entries_of(held, part)
                    held, entries = [], 0
        if entries:
            yield entries_of(held, part)

    def entries_of(held: list, part: int) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        out = list(_blocks(columns, (columns[1] - COLD) * buckets // cold_words, ENTRY))
        return _rows(len(out), bucket=[x[2] for x in out], part=[part] * len(out), rows=[x[1] - x[0] for x in out],
                     data=[x[3] for x in out])

    def settle(batches) -> Iterator[pa.RecordBatch]:
        """Rows of documents as they are, and blocks of the sums of each bucket's entries by their documents' task."""
        m, held, at = shared.value, [], None
        for batch in batches:
            plain = batch.filter(batch.column("data").is_null())
            if plain.num_rows:
                yield plain
            full = batch.filter(batch.column("data").is_valid())
            for bucket, part, rows, data in zip(*[full.column(i).to_pylist() for i in range(4)], strict=True):
                if held and bucket != at:
                    yield sums_of(m, held)
                    held = []
                at = bucket
                uid, *rest = unpacked(data, rows, ENTRY)
                held.append([(part << ROW_BITS) + uid, *rest])
        if held:
            yield sums_of(m, held)

    def sums_of(m: Models, held: list) -> pa.RecordBatch:
        docs, sums = of_bucket(m, *[np.concatenate(c) for c in zip(*held, strict=True)])
        part, row = docs >> ROW_BITS, docs & (1 << ROW_BITS) - 1
        out = list(_blocks([row, *_fixed(sums)], part, SUM))
        return _rows(len(out), part=[x[2] for x in out], rows=[x[1] - x[0] for x in out], data=[x[3] for x in out])

    def add(batches) -> Iterator[pa.RecordBatch]:
        """The documents of each dealing task with all their sums."""
        at, rows, blocks = None, [], []
        for batch in batches:
            ends = np.flatnonzero(np.diff(batch.column("part").to_numpy())) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
                one = batch.slice(a, b - a)
                if not one.num_rows:
                    continue
                if at is not None and one.column("part")[0].as_py() != at:
                    yield total(rows, blocks)
                    rows, blocks = [], []
                at = one.column("part")[0].as_py()
                rows.append(one.filter(one.column("data").is_null()).select(_NAMES[4:]))
                full = one.filter(one.column("data").is_valid())
                blocks += zip(full.column("data").to_pylist(), full.column("rows").to_pylist(), strict=True)
        if at is not None:
            yield total(rows, blocks)

    def total(rows: list, blocks: list) -> pa.RecordBatch:
        docs = pa.Table.from_batches(rows).combine_chunks()
        uid = docs["uid"].to_numpy()
        place = np.zeros(int(uid.max(initial=-1)) + 1, dtype=np.int64)
        place[uid] = np.arange(len(uid))
        sums = [docs[c].to_numpy().copy() for c in ("target", "background")]
        for data, n in blocks:
            row, *more = unpacked(data, n, SUM)
            for s, x in zip(sums, more, strict=True):
                s[place[row]] += x  # a document stands once in a block
        return pa.RecordBatch.from_arrays(
            [docs["doc_id"].combine_chunks(), docs["n_tokens"].combine_chunks(),
             *[pa.array(s / (1 << SUM_BITS)) for s in sums]], names=["doc_id", "n_tokens", "target", "background"])

    dealt = texts.select("doc_id", "text", "target").mapInArrow(deal, BLOCKS)
    settled = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, BLOCKS)
    sums = settled.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        add, "doc_id long, n_tokens long, target double, background double")
    loss = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return sums.select("doc_id", "n_tokens", loss("target").alias("target_loss"),
                       loss("background").alias("background_loss")).withColumn(
        "score", F.coalesce(F.col("background_loss") - F.col("target_loss"), F.lit(0.0)))
