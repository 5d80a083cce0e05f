"""Packing and mixing: exact round trips, bounds, ties and odd inputs."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from allelo.llm import mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pieces_equal_the_tokenizer(odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(odd_docs, PATH, with_ids=True).collect()
    check_places(rows, packing.CAPACITY)
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows)
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            cut = ids[at: at + packing.CAPACITY].tobytes()
            want[r["doc_id"], n, at, len(cut) // 4, zlib.crc32(cut), cut] += 1
    assert got == want
    assert packing.pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("words", ["Don't stop, it's 100% o'clock... e.g. (a-b)!", "ÉLÈVE ça ß Straße ǅ ŉ i̇", "a\x1cb \x85c d",
                                   "x" * 700 + "," * 30 + " <|endoftext|> <|startoftext|>hi", "Σίσυφος ΣΑΣ İstanbul"])
def test_word_cache_equals_the_tokenizer(words):
    cache = packing.WordCache(PATH)
    plain = np.array(cache.tokenizer.encode(words, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert list(cache.many([words, "", words])) == [plain, b"", plain]


def test_word_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    monkeypatch.setattr(packing, "GROUP", 20)
    cache = packing.WordCache(PATH)
    texts = ["the cat, sat on", "the mat and the hat", "a cat a mat! the", "the the the"] * 3
    plain = [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(cache.many(texts)) == plain


@pytest.mark.parametrize(("lengths", "capacity", "ranges"), [
    ([3] * 500, 10, 20), ([1] * 3000, 64, 50), ([5, 5, 5, 5], 10, 100), ([7] * 40 + [3] * 40, 10, 7),
    (list(range(1, 101)) * 3, 100, 40), ([10] * 5, 10, 3), ([], 10, 3)])
def test_best_fit_is_near_the_bound(spark, monkeypatch, lengths, capacity, ranges):
    monkeypatch.setattr(packing, "RANGE_ROWS", ranges)
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long")
    rows = packing.pack(items, capacity).join(items, "item").collect()
    assert sorted(r["item"] for r in rows) == list(range(len(lengths)))
    used = check_places(rows, capacity)
    per = capacity // min(lengths) if len(set(lengths)) == 1 else 0
    bound = -(-len(lengths) // per) if per else max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))
    assert bound <= used <= bound * 1.15 + 1


def test_match_runs_resolves_by_rank():
    # range 0 leaves gaps, range 1 pieces: three pieces of at most 4 fit into a gap of at least 12
    assert packing.match_runs([(0, 0, 0, 2, 12), (1, 5, 4, 0, 0)]) == [(1, 0, 5, 0, 1, 3)]
    assert packing.match_runs([(0, 3, 9, 0, 0), (1, 0, 0, 4, 8)]) == []


def test_mix_hits_its_targets(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        words = r["whole"] * r["size"] + r["part"]
        assert 0 <= words <= mixing.MAX_EPOCHS * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += words
        target[r["source"]] = r["target"]
        assert r["target"] <= mixing.MAX_EPOCHS * r["source_size"]
    total = mixing.SHARE * sum(sizes.values())
    assert sum(target.values()) == pytest.approx(total)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-9
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    levels = {s: target[s] / mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    open_ = [levels[s] for s in order if target[s] < mixing.MAX_EPOCHS * sizes[s] - 1e-9]
    assert max(open_) == pytest.approx(min(open_)) if open_ else True
    assert all(levels[s] <= max(open_, default=np.inf) + 1e-9 for s in order)
    again = mixing.mix(odd_docs.repartition(3)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat(no_docs).count() == 0


def test_repeat_keeps_columns_and_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(300)] + [(None, None, None)],
                                 "doc_id long, text string, source string")
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    for s in ("s0", "s1", "s2"):
        assert abs(words[s] - target[s]) <= 7


def test_infeasible_share_caps_every_source(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b c", "y")], "doc_id long, text string, source string")
    assert [(r["whole"], r["part"]) for r in mixing.mix(docs, share=5).collect()] == [(2, 0), (2, 0)]
