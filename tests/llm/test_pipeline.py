"""The pipeline's stages, one after the other, against brute-force versions."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from allelo.llm import mixing, quality, suffixes

from .test_packing_mixing import check_places
from .test_pairs import brute_components

pytest.importorskip("public_tokenizers")


def corpus():
    """Clean prose, junk, near copies, a shared passage, copies and odd rows."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(rng.randint(60, 300)) + ".", "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, " ".join(f"{rng.choice(words).upper()}!!" for _ in range(120)), "en", "s1") for i in range(20)]
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 1) + " more", "en", "s2") for i in range(10)]
    rows += [(300 + i, prose(80) + "\n" + passage + "\n" + prose(80), "en", None) for i in range(8)]
    rows += [(400, rows[5][1], "en", "s3"), (401, None, None, None), (402, "", "en", "s0"), (403, "short", "en", "s0"),
             (404, prose(5000), "en", "s0")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").coalesce(2) \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(10)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    chain = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    seen = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == columns and dict(docs.dtypes)["n_chars"] == "bigint"
    key = lambda r: str(r)
    kept = [r for r in before if quality.verdict(r[1], chain, quality.SHARE)]
    assert sorted(seen[0], key=key) == sorted(kept, key=key)
    assert {r[0] for r in kept} >= set(range(60)) and not {r[0] for r in kept} & {*range(100, 120), 401, 402, 403}

    groups = {d: c for d, _, c in brute_components([(r[0], r[1]) for r in kept], 5, 80, 100)}
    single = [r for r in kept if groups[r[0]] == r[0]]
    assert sorted(seen[1], key=key) == sorted(single, key=key) and len(single) <= len(kept) - 11

    least, want = {}, []
    raw = sorted((r[0], r[1].encode(), r) for r in single)
    for d, t, _ in raw:
        for i in range(len(t) - 49):
            least.setdefault(t[i:i + 50], d)
    for d, t, r in raw:
        gone = suffixes.merged([i << 32 | 50 for i in range(len(t) - 49) if least[t[i:i + 50]] < d])
        left = suffixes.cut(t, gone).decode("utf-8", "ignore")
        if left.strip():
            want.append((d, left, r[2], r[3], len(left)))
    assert sorted(seen[2], key=key) == sorted(want, key=key)
    assert sum(len(r[1]) for r in want) < sum(len(r[1]) for r in single)

    taken, size = Counter(), Counter()
    for r in seen[3]:
        taken[r[3]] += len(r[1].split())
    for r in want:
        size[r[3]] += len(r[1].split())
    assert set(seen[3]) <= set(want) and max(Counter(seen[3]).values()) <= mixing.MAX_EPOCHS
    longest = max(len(r[1].split()) for r in want)
    assert abs(sum(taken.values()) - mixing.SHARE * sum(size.values())) <= longest * len(size)

    pieces = [r.asDict() for r in docs.collect()]
    used = check_places(pieces, 2048)
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] for p in pieces)
    assert used <= -(-sum(p["length"] for p in pieces) // 2048) + 2
    assert Counter(p["doc_id"] for p in pieces if p["piece"] == 0) == Counter(r[0] for r in seen[3])


def test_run_gives_the_last_stage(spark, folder):
    rows = [r.asDict() for r in pipeline.run(spark, folder).collect()]
    check_places(rows, 2048)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0])


def test_empty_corpus(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
