"""Operators that judge one document at a time: language, quality, licenses, LM scores."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelo.llm import langid, licenses, quality, queries, scoring
from allelo.llm.common import held_out

from .conftest import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest_match_phrases(text, training):
    """Greedy cross-parse by plain substring search."""
    phrases, phrase = 1, ""
    for c in text:
        phrase += c
        if phrase not in training:
            phrases += 1
            phrase = c if c in training else ""
    return phrases


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = "abracadabra"
    nxt = langid.suffix_automaton(text)

    def accepts(s):
        state = 0
        for c in s:
            if c not in nxt[state]:
                return False
            state = nxt[state][c]
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(accepts(s) for s in subs)
    assert not any(accepts(s) for s in ("abb", "cadabraa", "x", "rab"))


def test_lockstep_parse_equals_substring_search():
    training = {"en": "the cat sat on the mat and the hat ", "fr": "le chat est sur le tapis et la table "}
    parser = langid.Parser(training)
    texts = ["the cat est sur", "zz the", "q", "la table and the hat " * 300, "sat" * 3000]
    codes = [parser.encode(t) for t in texts]
    many = parser.phrases_many(codes)
    for text, c, row in zip(texts, codes, many, strict=True):
        assert row.tolist() == parser.phrases(c).tolist()
        plain = langid.normalise(text) if text.endswith(" ") else langid.normalise(text)[:-1]
        if len(plain) <= langid.BLOCK:
            assert row.tolist() == [longest_match_phrases(plain, training[lang]) for lang in parser.langs]


def test_langid_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op1_langid(spark, "/root/testdata/sf0.01").collect()}
    truth = [r for r in table("/root/testdata/sf0.01", "documents") if len(r["text"] or "") > 40]
    judged = [(rows[r["doc_id"]]["lang_pred"] == r["lang"]) for r in truth if rows[r["doc_id"]]["held_out"]]
    assert len(judged) > 100 and np.mean(judged) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_a_language_of_two_letters_takes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    training = langid.training_text(docs)
    assert max(map(len, training.values())) <= langid.SAMPLE_CHARS
    stray = langid.identify(docs, training | {"xx": "ok "})
    plain = langid.identify(docs, training).withColumnRenamed("lang_pred", "plain")
    both = stray.join(plain.select("doc_id", "plain"), "doc_id").where("plain != 'und'")
    assert both.where("lang_pred = 'xx'").count() == 0
    assert both.where("lang_pred = plain").count() >= 0.99 * both.count()


def test_training_takes_pieces_from_anywhere_and_many_languages(spark):
    rows = [(d, "start " * 400 + f"w{'abcdefghij'[d % 10]}nd " * 400, "en") for d in range(200)]
    rows += [(1000 + k, f"mot{'abcdefgh'[k % 8]} langue", f"l{k:04d}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = langid.training_text(docs, all_chars=40_000)
    assert len(training) > 1000 and sum(map(len, training.values())) <= 2 * 40_000
    long = langid.training_text(docs.where("lang = 'en'"))["en"]
    assert "start" in long and "nd" in long and len(long) <= langid.SAMPLE_CHARS


def test_langid_odd_rows(odd_docs, no_docs):
    training = langid.training_text(odd_docs)
    out = [tuple(r) for r in langid.identify(odd_docs, training).collect()]
    assert len(out) == odd_docs.count()
    by_id = defaultdict(list)
    for doc_id, lang, score, _ in out:
        by_id[doc_id].append((lang, score))
    for doc_id in (4, 5, 6, 11):
        assert set(by_id[doc_id]) == {("und", 0.0)}
    assert all(lang != "und" for lang, _ in by_id[1] + by_id[8] + by_id[10])
    assert langid.training_text(no_docs) == {} and langid.identify(no_docs, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, {}).collect()} == {"und"}


def base_counts(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), failed)


def test_quality_base_counts_and_kept(spark, odd_docs, no_docs):
    chain = quality.Chain()
    got = [tuple(r)[:7] for r in quality.judge(odd_docs, chain).drop("line_labels").collect()]
    want = [(r["doc_id"], *base_counts(r["text"])) for r in odd_docs.collect()]
    key = lambda t: str(t)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = quality.judge(odd_docs, chain).where("kept").count()
    assert quality.keep(odd_docs, chain).count() == kept > 0
    assert quality.keep(odd_docs, chain).columns == odd_docs.columns
    assert quality.judge(no_docs, chain).count() == 0 and quality.keep(no_docs, chain).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert (quality.fit(no_docs, empty).weights == quality.PRIOR).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.integers(0, 2, (6, len(quality.FEATURES))).astype(float)
        chain = quality.Chain(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)))
        emit = x @ chain.weights

        def value(path, emit=emit, chain=chain):
            return sum(emit[i] * s for i, s in enumerate(path)) + sum(
                chain.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
        paths = [[m >> i & 1 for i in range(6)] for m in range(64)]
        assert value(chain.viterbi(x)) == pytest.approx(max(map(value, paths)))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 4, len(quality.FEATURES)))
    mask = np.array([[True] * 4, [True, True, False, False]])
    chain = quality.Chain(rng.normal(size=len(quality.FEATURES)) * 0.3, rng.normal(size=(2, 2)))
    p, pairs = quality.batch_marginals(chain, x, mask)
    for s, n in ((0, 4), (1, 2)):
        emit = x[s] @ chain.weights
        total, ones, moves = 0.0, np.zeros(4), np.zeros((2, 2))
        for m in range(1 << n):
            path = [m >> i & 1 for i in range(n)]
            w = np.exp(sum(emit[i] * b for i, b in enumerate(path))
                       + sum(chain.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for i, b in enumerate(path):
                ones[i] += w * b
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += w
        assert p[s] == pytest.approx(ones / total) and pairs[s] == pytest.approx(moves / total)


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op5_quality(spark, sf).collect()}
    labels = [r for r in table(sf, "labels") if r["doc_id"] in rows and not rows[r["doc_id"]]["base_failed"]]
    good = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    bad = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = LICENSE_WORD.findall(lower)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_and_join_by_brute_force(spark, odd_docs):
    extra = spark.createDataFrame([
        (100, "x\nReleased under the MIT License.\nUNDER THE MIT LICENSE under the mit license"),
        (101, "Licensed under CC BY-NC 4.0; Apache License, Version 2.0"), (102, "All rights\nreserved"),
        (103, " ".join(f"w{i}" for i in range(300)) + " this work is licensed under the gnu general public license version 3"),
        (104, "all rights reserved"), (105, "permission is hereby granted free of charge to any person obtaining a copy")],
        "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    scanned = licenses.scan(docs).collect()
    got = [tuple(r) for r in licenses.report(licenses.scan(docs)).collect()]
    rows = docs.collect()
    assert sorted(map(str, (r[:6] for r in got))) == sorted(str((r["doc_id"], *license_base(r["text"]))) for r in rows)
    for r in rows:
        want = plain_license_hits(r["text"])
        mine = [sorted(zip(x["blocks"], x["block_labels"], x["block_scores"], strict=True)) for x in scanned
                if x["doc_id"] == r["doc_id"]]
        assert want in mine, r["doc_id"]
    labels = {r[0]: r[6] for r in got}
    assert labels[103] == "gpl-3" and labels[104] == labels[102] == "all-rights-reserved"
    assert "apache-2" in labels[101] and "cc-by-nc" in labels[101]


def plain_license_hits(text):
    """(block, label, share) of every template, by all windows, with the best of a family where windows overlap."""
    lines = [LICENSE_WORD.findall(x) for x in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split("\n")]
    ws = [w for line in lines for w in line]
    windows, at = [], 0
    for line in lines:
        windows += [(at + k, line[k:k + 64]) for k in range(0, max(len(line) - 32, 1), 32) if line]
        at += len(line)
    whole = [(k, ws[k:k + 64]) for k in range(0, max(len(ws) - 32, 1), 32) if ws] if len(lines) > 1 else []
    sets = [set(body.split()) for _, body in licenses.TEMPLATES]
    hits = []
    for i, (label, body) in enumerate(licenses.TEMPLATES):
        if len(sets[i]) <= 3:
            words = body.split()
            hits += [(k, k + len(words), i, 1.0) for k in range(len(ws)) if ws[k:k + len(words)] == words]
            continue
        share = lambda block: len(sets[i] & set(block)) / len(sets[i])
        mine = [(k, k + len(block), i, share(block)) for k, block in windows if share(block) >= 0.8]
        hits += mine
        hits += [(k, k + len(block), i, share(block)) for k, block in whole if share(block) >= 0.8 and not any(
            a < k + len(block) and k < b and s >= share(block) for a, b, _, s in mine)]

    def beaten(x):
        return any(a < x[1] and x[0] < b and licenses.TEMPLATES[j][0] != licenses.TEMPLATES[x[2]][0]
                   and len(sets[j] & sets[x[2]]) >= 0.8 * min(len(sets[j]), len(sets[x[2]]))
                   and (s, len(sets[j])) > (x[3], len(sets[x[2]])) for a, b, j, s in hits)

    return sorted((x[0], licenses.TEMPLATES[x[2]][0], x[3]) for x in hits if not beaten(x))


LGPL = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.")
GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
       "Public License as published by the Free Software Foundation, either version {} of the License, or (at your "
       "option) any later version.")


@pytest.mark.parametrize(("text", "labels"), [
    (LGPL, "lgpl-2.1"), (GPL.format(3), "gpl-3"), (GPL.format(2), "gpl-2"), (GPL.split(" as published")[0], "gpl"),
    (GPL.format(3).replace("GNU General", "GNU Affero General"), "agpl-3"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution Share Alike License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
     "cc-by-nc-nd"),
    ("All\nrights\nreserved", "all-rights-reserved"), ("All the rights are reserved", ""), ("rights reserved all", ""),
    ("Redistribution and use in source are permitted", ""), ("the general public may use this program", "")])
def test_nested_templates_and_near_misses(spark, text, labels):
    docs = spark.createDataFrame([(1, text), (2, "\n".join(text.split(" ")))], "doc_id long, text string")
    assert {r["labels"] for r in licenses.report(licenses.scan(docs)).collect()} == {labels}


def test_quality_learns_from_every_line(spark):
    """Lines beyond any prefix count: boilerplate at the end of long documents is learned."""
    bad = "\n".join(["plain words that say little at all"] * 300 + ["<<| $$ ## | && % |>>"] * 300)
    docs = spark.createDataFrame([(d, bad if d % 2 else "plain words that say little at all\n" * 600) for d in range(8)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1 - d % 2) for d in range(8)], "doc_id long, quality int")
    sequences = quality.training_sequences(docs, labels)
    assert sorted(len(x) for x, _ in sequences) == [600] * 8
    chain = quality.fit(docs, labels)
    symbols = quality.FEATURES.index("many symbols")
    assert chain.weights[symbols] > quality.PRIOR[symbols] - 1e-9
    whole = quality.fit_chain(sequences)
    assert np.allclose(chain.weights, whole.weights)


def test_license_empty(no_docs):
    assert licenses.scan(no_docs).count() == 0


def test_scores_by_brute_force(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (3, 1), (8, 1), (12, 1), (13, 0), (None, 1)], "doc_id long, quality int")
    texts = scoring.marked(odd_docs, labels)
    models = scoring.fit(texts, size=50)
    rows = texts.collect()
    counts = Counter(w for r in rows for w in scoring.words(r["text"]))
    vocab = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50]]
    assert list(models.index) == vocab
    tables = []
    for only in (False, True):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for r in rows:
            if r["target"] or not only:
                ids = [models.index.get(w, 1) for w in scoring.words(r["text"])]
                uni.update(ids)
                ctx.update([0, *ids][:-1] if ids else [])
                bi.update(zip([0, *ids], ids, strict=False))
        tables.append((uni, ctx, bi))
    n, n_target = (sum(t[0].values()) for t in tables)

    def loss(tab, total, ids, own, scale):
        uni, ctx, bi = (Counter(c) for c in tab)
        if own:
            uni.subtract(ids)
            ctx.subtract([0, *ids][:-1])
            bi.subtract(zip([0, *ids], ids, strict=False))
            total -= len(ids)
        out = 0.0
        for v, w in zip([0, *ids], ids, strict=False):
            p = (scale * uni[w] + 1) / (scale * total + 52)
            out -= np.log2((scale * bi[v, w] + scoring.MASS * p) / (scale * ctx[v] + scoring.MASS))
        return out / len(ids)

    want = []
    for r in rows:
        ids = [models.index.get(w, 1) for w in scoring.words(r["text"])]
        if ids:
            t = loss(tables[1], n_target, ids, r["target"], 1.0)
            b = loss(tables[0], n, ids, True, n_target / n)
            want.append((r["doc_id"], len(ids), round(t, 6), round(b, 6), round(b - t, 6)))
        else:
            want.append((r["doc_id"], 0, None, None, 0.0))
    got = [(r[0], r[1], *[None if x is None else round(x, 6) for x in r[2:]]) for r in scoring.score(texts, models).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and [x for x in a[2:]] == pytest.approx([x for x in b[2:]], abs=1e-5)


def test_scores_rank_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["score"] for r in queries.op9_scoring(spark, sf).collect()}
    labels = table(sf, "labels")
    good = np.array([rows[r["doc_id"]] for r in labels if r["quality"] == 1])
    bad = np.array([rows[r["doc_id"]] for r in labels if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_scores_empty(spark, no_docs):
    texts = scoring.marked(no_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert scoring.score(texts, scoring.fit(texts)).count() == 0


def test_every_labelled_document_is_target(spark):
    many = spark.range(30_000).selectExpr("id doc_id", "'a b' text")
    labels = spark.range(30_000).selectExpr("id doc_id", "1 quality")
    want = many.where(~held_out(F.col("doc_id"))).count()
    assert want > 20_000
    for ids in (scoring.BROADCAST_IDS, 10):  # sent to the texts, and met in a shuffle
        marked = scoring.marked(many, labels, broadcast_ids=ids)
        assert marked.count() == 30_000 and marked.where("target").count() == want


@pytest.mark.parametrize(("hot", "least"), [(1024, 1), (30, 2), (0, 1)])
def test_scores_of_the_whole_vocabulary_by_brute_force(spark, odd_docs, hot, least):
    labels = spark.createDataFrame([(1, 1), (3, 1), (8, 1), (12, 1), (13, 0), (None, 1)], "doc_id long, quality int")
    rare = spark.createDataFrame([(20, " ".join(f"w{i} w{i * i} w{i}" for i in range(3000))), (21, "w7 w49 the w7 w49 w7")],
                                 "doc_id long, text string")
    texts = scoring.marked(odd_docs.select("doc_id", "text").unionByName(rare), labels)
    rows = [(r["doc_id"], scoring.words(r["text"]), r["target"]) for r in texts.collect()]
    often = Counter(w for _, ws, _ in rows for w in ws)
    rows = [(key, [w if often[w] >= least else "rare" for w in ws], target) for key, ws, target in rows]
    tables = []
    for only in (False, True):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for _, ws, target in rows:
            if target or not only:
                uni.update(ws)
                ctx.update([None, *ws][:-1] if ws else [])
                bi.update(zip([None, *ws], ws, strict=False))
        tables.append((uni, ctx, bi))
    n, n_target = (sum(t[0].values()) for t in tables)
    size = sum(n >= least for n in often.values()) + 2
    assert size > 1024 + 2

    def loss(tab, total, ws, own, scale):
        uni, ctx, bi = Counter(), Counter(), Counter()
        if own:
            uni.update(ws)
            ctx.update([None, *ws][:-1])
            bi.update(zip([None, *ws], ws, strict=False))
            total -= len(ws)
        out = 0.0
        for v, w in zip([None, *ws], ws, strict=False):
            p = (scale * (tab[0][w] - uni[w]) + 1) / (scale * total + size)
            out -= np.log2((scale * (tab[2][v, w] - bi[v, w]) + scoring.MASS * p)
                           / (scale * (tab[1][v] - ctx[v]) + scoring.MASS))
        return out / len(ws)

    want = []
    for key, ws, target in rows:
        t, b = ((loss(tables[1], n_target, ws, target, 1.0), loss(tables[0], n, ws, True, n_target / n))
                if ws else (None, None))
        want.append((key, len(ws), t, b, b - t if ws else 0.0))
    got = [tuple(r) for r in scoring.score(texts, scoring.fit(texts, hot=hot, least=least), bucket_tokens=5000).collect()]
    assert len(got) == len(want)
    by = lambda r: (str(r[0]), r[1], -1.0 if r[2] is None else round(r[2], 5))
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert a[:2] == b[:2] and list(a[2:]) == pytest.approx(list(b[2:]), abs=1e-6)


def test_license_notices_over_line_ends(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU "
           "General Public License")
    pad = "\n".join(f"v{i} u{i}" for i in range(90))
    rows = [(1, bsd), (2, gpl), (3, f"{pad}\n{bsd}\n{pad}\n{gpl}\n{pad}"), (4, gpl.replace(" ", "\n")), (5, pad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.report(licenses.scan(docs)).collect()}
    for key, text in rows:
        assert labels[key] == ",".join(sorted({label for _, label, _ in plain_license_hits(text)}))
    assert labels == {1: "bsd", 2: "gpl", 3: "bsd,gpl", 4: "gpl", 5: ""}


def test_scoring_sorts_one_number_and_looks_new_words_up_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    for high in (50, 2**40):  # keys that fit one number together, and keys that do not
        keys = [rng.integers(0, high, 3000) // (high // 50) * (high // 50) for _ in range(3)]
        order, group = scoring.groups(*keys)
        want = np.lexsort(keys[::-1])
        assert (order == want).all() and group[-1] == len(set(zip(*keys))) - 1
        found, n = scoring.counted(*keys)
        assert dict(zip(zip(*[k.tolist() for k in found]), n.tolist())) == Counter(zip(*[k.tolist() for k in keys]))
    assert [len(x) for x in scoring.groups(np.zeros(0, "i8"))] == [0, 0] and not len(scoring.counted(np.zeros(0, "i8"))[1])

    known = np.unique([scoring.word_hash(b"w%d" % i) for i in range(40)])
    texts = ["a  w1 w2 a b" + chr(10) + "w1", None, "", "w39 w40 A"]
    ids = scoring.encode(texts, scoring.Ids({b"a": 2}, known))
    place = {b"w%d" % i: scoring.COLD + int(known.searchsorted(scoring.word_hash(b"w%d" % i))) for i in range(40)}
    assert [i.tolist() for i in ids] == [[{b"a": 2}.get(w, place.get(w, 1)) for w in scoring.words(t)] for t in texts]
    few = scoring.Ids({b"a": 2}, known)
    few.most = 3  # a full cache only looks up again
    assert [i.tolist() for _ in range(2) for i in scoring.encode(texts, few)][4:] == [i.tolist() for i in ids]

    monkeypatch.setattr(np, "lexsort", None)  # 4 to 8 times the time of a sort of whole numbers
    counts = scoring.Counts(4)
    for held in (counts.words, counts.contexts, counts.pairs):
        held += 100
    models = scoring.Models([b"a"], known, counts, counts)
    sums, entries = scoring.of_group(models, [(i, x, True) for i, x in enumerate(ids)])
    assert sums.shape == (2, 4) and len(entries[0]) == 4 + 2
