"""Importance resampling, byte-level BPE and ranked search against brute force, and their odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelo.llm import bpe, queries, resampling, search
from allelo.tables import load

from .conftest import SF, table

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# -- BPE -----------------------------------------------------------------------


def agrees(codec, library, texts):
    got = list(codec.encode(texts))
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    for text, ids in zip(texts, got, strict=True):
        assert codec.decode(ids) == text == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_every_kind_of_character(library):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    chosen = points[:0x800] + points[0x800::53]
    agrees(bpe.Codec(PATH), library, [f"a{chr(i)}b {chr(i)} 1{chr(i)}{chr(i)}  {chr(i)}x\n" for i in chosen])


@pytest.mark.parametrize("short", [2, 64])
def test_rank_array_and_heap_equal_the_library(library, monkeypatch, short):
    monkeypatch.setattr(bpe, "SHORT", short)
    rng = random.Random(5)
    parts = ["a", "b", "é", "漢", " ", "  ", "\n", "\t", "'s", "'ll", "1", "!", "<|endoftext|>", "\x1c", "\x85", "\xa0",
             "the", "ing", "X", " ", "<|endof", "tokenization", "aaaa"]
    agrees(bpe.Codec(PATH), library, ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)])


def test_small_groups_segments_and_caches(library, monkeypatch):
    for name, value in (("CACHE_WORDS", 5), ("GROUP", 15), ("SEGMENT", 7), ("RUN", 2)):
        monkeypatch.setattr(bpe, name, value)
    texts = ["the cat, sat  on \n the mat", "", "a cat a mat! the<|endoftext|>x", "   ", "word", "a b \n \nc d  e f g h "] * 3
    agrees(bpe.Codec(PATH), library, texts)


def test_long_words_and_other_files(library, tmp_path):
    agrees(bpe.Codec(PATH), library, ["x" * 9000, "ab" * 3000, "漢字" * 2000, "a" * 65 + " " + "-" * 400])
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))


def test_decoding_skips_unknown_ids():
    codec = bpe.Codec(PATH)
    ids = next(codec.encode(["über"]))
    assert codec.decode(ids + (10**6).to_bytes(4, "little")) == "über"
    assert codec.decode(codec.first[0xC3].item().to_bytes(4, "little")) == "\ufffd"


def test_bpe_on_odd_documents(odd_docs, no_docs, library):
    rows = bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in rows)
    want = Counter()
    for r in odd_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), np.array(ids, dtype="<u4").tobytes(), r["text"] or ""] += 1
    assert got == want
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_bpe_query(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
           for r in queries.op12_bpe(spark, SF).collect()}
    for r in table(SF, "documents"):
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids, dtype="<u4")
        assert got.pop(r["doc_id"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                                        hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert not got


# -- importance resampling -------------------------------------------------------


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_resample(docs, target, most=1, buckets=10_000, percent=10, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets
                for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in rows for b in features(x)) for rows in ([d for _, d in docs], target))
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
    out = []
    for doc, text in docs:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words(text)), len(f), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("most", "buckets", "percent", "slice_"), [(1, 10_000, 10, 1 << 24), (3, 50, 60, 1000)])
def test_resampling_equals_brute_force(spark, odd_docs, no_docs, monkeypatch, most, buckets, percent, slice_):
    monkeypatch.setattr(resampling, "SLICE", slice_)
    bench = load(spark, SF, "benchmark").withColumn("score", F.lit("clash"))
    features = resampling.Features(most, buckets)
    for docs in (odd_docs, load(spark, SF, "documents")):
        got = Counter(map(tuple, resampling.resample(docs, bench, percent, features=features).collect()))
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = plain_resample(rows, [r["text"] for r in bench.collect()], most, buckets, percent)
        assert got == want
    assert resampling.resample(no_docs, bench).count() == 0
    assert resampling.resample(odd_docs, bench.where("false")).count() == odd_docs.count()


def test_ranks_are_dense_with_one_repeated_row(spark):
    docs = spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("w " * 30).alias("text"))
    ranks = [r["rank"] for r in resampling.resample(docs, docs, percent=50).collect()]
    assert sorted(x for x in ranks if x is not None) == list(range(1, 1001)) and len(ranks) == 2000


# -- search ------------------------------------------------------------------------


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs) if w]
    n_docs, length, df = len(held), sum(n for *_, n in held), Counter(w for _, c, _ in held for w in c)
    out = Counter()
    for item, text in items:
        scored = []
        for doc, c, n in held:
            m = 10 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


@pytest.mark.parametrize(("k", "rows", "chunk", "bits", "block"), [(10, 8192, 64, 62, 20_000), (3, 7, 1, 3, 60)])
def test_search_equals_brute_force(spark, odd_docs, monkeypatch, k, rows, chunk, bits, block):
    for name, value in (("ROWS", rows), ("CHUNK", chunk), ("BITS", bits)):
        monkeypatch.setattr(search, name, value)
    long_item = " ".join({w for r in odd_docs.collect() for w in (r["text"] or "").split()})
    extra = [(90, None, "x"), (91, "", "x"), (92, "!!", "x"), (93, "absentterm", "x"), (94, long_item, "x"),
             (94, "word A a", "x"), (None, "ÜNÏ наука É", "x")]
    items = load(spark, SF, "benchmark").withColumn("score", F.lit("clash"))
    items = items.unionByName(spark.createDataFrame(extra, "item_id long, text string, score string"))
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    for docs in (odd_docs, load(spark, SF, "documents")):
        got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"])
                      for r in search.search(docs, items, k, block).collect())
        assert got == plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], asked, k)


def test_search_of_empty_tables_and_equal_documents(spark, odd_docs, no_docs):
    items = load(spark, SF, "benchmark")
    assert search.search(no_docs, items).count() == 0
    assert search.search(odd_docs, items.where("false")).count() == 0
    docs = spark.range(5000).select((4999 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same words")
                                    .otherwise("other text").alias("text"))
    items = spark.createDataFrame([(1, "same lines")], "item_id long, text string")
    got = [(r["rank"], r["doc_id"]) for r in search.search(docs, items).orderBy("rank").collect()]
    assert got == [(k + 1, 2 * k + 1) for k in range(10)]  # ties go to the smaller id


def test_masks_group_rows_by_the_terms_they_hold():
    masks = np.array([[0, 1, 1, 3, 0, 3], [0, 0, 0, 1, 0, 1]])
    group, held = search.groups_by_mask(masks)
    assert held.tolist() == [1, 2, 3, 5] and group[0] == group[1] != group[2] == group[3]
