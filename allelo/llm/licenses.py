"""License scans by an exact set-similarity join against license templates.

A text block is one line of a document; a line of more than ``BLOCK`` words
gives overlapping blocks of ``BLOCK`` words, one every ``BLOCK / 2``, so a
notice stays whole and a long line does not match by its length.  The same
blocks over the whole word sequence of a document find notices that run over
line ends: such a block counts where it holds more of the template than every
line's block within its reach.  A template of up to ``SHORT`` distinct tokens says
little as a set: it matches where its words stand one after the other, over line
ends too.  Templates that share most of their tokens (a license's versions, a
license and its variant) are a family: where blocks of a family overlap, only the
template that holds the greatest share, then the most tokens, is reported.  A block
matches a template when it holds at least ``containment`` of the template's
distinct tokens.  Tokens are
ordered globally by their frequency over all documents (rare first).  The join
then needs three exact filters before it verifies:

* prefix: a block that misses all of a template's ``n - ceil(c * n) + 1``
  rarest tokens cannot reach the threshold;
* length: a block needs at least ``ceil(c * n)`` distinct tokens;
* position: walking the template in token order, once more than
  ``n - ceil(c * n)`` tokens have been missed the block is given up.

The templates are a stated, bounded query set, so they travel with the task;
documents are scanned once and never shuffled.

Defined results: null or empty text has no words, no places, empty labels and
score 0; repeated rows each give their own row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelo.llm.common import arrow_map, narrow

# Phrases of the base scan and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of common license notices with their labels.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is "
                 "distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the "
              "gnu general public license as published by the free software foundation either version 2 of the license "
              "or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the "
              "gnu general public license as published by the free software foundation either version 3 of the license "
              "or at your option any later version"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the "
             "gnu lesser general public license"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the "
                 "gnu lesser general public license as published by the free software foundation either version 2 1 of "
                 "the license or at your option any later version"),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the "
               "gnu lesser general public license as published by the free software foundation either version 3 of "
               "the license or at your option any later version"),
    ("lgpl-2.1", "this work is licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the "
               "gnu affero general public license as published by the free software foundation either version 3 of "
               "the license or at your option any later version"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public "
              "license 2 0"),
    ("boost-1", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 "
                    "international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 "
                    "international license"),
    ("all-rights-reserved", "all rights reserved"),
]

CONTAINMENT = 0.8
BLOCK = 64
SHORT = 3  # templates of so few tokens match word after word

# lower-cases A-Z; keeps 0-9, a-z and all non-ASCII bytes; everything else separates words
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122
               else 10 if c == 10 else 32 for c in range(256))


def words(text: str | None) -> bytes:
    """The text's bytes with words separated by blanks and lines kept."""
    return (text or "").encode("utf-8", "replace").translate(_CLASS)


def token_frequencies(docs: DataFrame, text: str = "text", templates=None) -> dict[bytes, int]:
    """How often each template token occurs over all documents (one bounded row per token)."""
    vocabulary = {t for _, body in (templates or TEMPLATES) for t in words(body).split()}

    def count(texts) -> Iterator[tuple]:
        total: Counter = Counter()
        for text in texts:
            seen = Counter(words(text).split())
            for t in vocabulary & seen.keys():
                total[t] += seen[t]
        yield from ((t.decode(), n) for t, n in total.items())

    rows = (arrow_map(narrow(docs, text=text), count, "token string, n long")
            .groupBy("token").agg(F.sum("n").alias("n")).collect())
    return {t: 0 for t in vocabulary} | {r["token"].encode(): r["n"] for r in rows}


def prepare(frequency: dict[bytes, int], templates=None, containment: float = CONTAINMENT) -> list[dict]:
    """Templates with their tokens in global order and the filters' bounds."""
    out = []
    for label, body in templates or TEMPLATES:
        tokens = sorted(set(words(body).split()), key=lambda t: (frequency.get(t, 0), t))
        need = math.ceil(containment * len(tokens) - 1e-9)
        out.append({"label": label, "tokens": tokens, "need": need,
                    "prefix": frozenset(tokens[: len(tokens) - need + 1]),
                    "phrase": b" ".join(words(body).split()) if len(tokens) <= SHORT else None})
    for t in out:
        t["family"] = frozenset(j for j, u in enumerate(out) if u["label"] != t["label"] and len(
            set(t["tokens"]) & set(u["tokens"])) >= containment * min(len(t["tokens"]), len(u["tokens"])))
    return out


def overlap(tokens: list[bytes], block: set[bytes], need: int) -> int:
    """Template tokens in the block, or 0 as soon as too many have been missed."""
    missed, spare = 0, len(tokens) - need
    for t in tokens:
        if t not in block:
            missed += 1
            if missed > spare:
                return 0
    return len(tokens) - missed


def matches(flat: bytes, everything: set[bytes], prepared: list[dict], rare: frozenset) -> list[tuple]:
    """(block, template index, containment) of every block at the threshold, the best of a family."""
    if rare.isdisjoint(everything):
        return []
    chances = [(i, t) for i, t in enumerate(prepared) if not t["prefix"].isdisjoint(everything)
               and overlap(t["tokens"], everything, t["need"])]
    found: list[tuple[int, int, int, float]] = []  # (first word, end, template, containment)
    sequence = b" ".join(flat.split()) if any(t["phrase"] for _, t in chances) else b""
    for i, t in chances:
        if t["phrase"]:
            found += [(at, at + t["phrase"].count(b" ") + 1, i, 1.0) for at in places(sequence, t["phrase"])]
    chances = [(i, t) for i, t in chances if not t["phrase"]]
    if chances:
        for at, line in blocks_of(flat):
            found += [(at, at + len(line), i, share) for i, share in held(set(line), chances)]
        if b"\n" in flat:
            lines = list(found)
            for at, block in blocks_of(flat.replace(b"\n", b" ")):
                for i, share in held(set(block), chances):
                    if all(share > s for a, b, j, s in lines if j == i and a < at + len(block) and at < b):
                        found.append((at, at + len(block), i, share))
    rank = lambda h: (h[3], len(prepared[h[2]]["tokens"]))
    return [(a, i, s) for a, b, i, s in found
            if not any(h[2] in prepared[i]["family"] and h[0] < b and a < h[1] and rank(h) > (s, len(prepared[i]["tokens"]))
                       for h in found)]


def held(block: set[bytes], chances: list[tuple[int, dict]]) -> Iterator[tuple[int, float]]:
    """(template index, containment) of the templates that the block matches."""
    for i, t in chances:
        if len(block) >= t["need"] and not t["prefix"].isdisjoint(block):
            if n := overlap(t["tokens"], block, t["need"]):
                yield i, n / len(t["tokens"])


def blocks_of(flat: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first word, words) of every block of the lines."""
    at = 0
    for line in flat.split(b"\n"):
        ws = line.split()
        for start in range(0, max(len(ws) - BLOCK // 2, 1), BLOCK // 2):
            if ws:
                yield at + start, ws[start: start + BLOCK]
        at += len(ws)


def places(flat_words: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase's words stand consecutively (overlaps count)."""
    out, needle, text = [], b" " + phrase + b" ", b" " + flat_words + b" "
    at, counted, seen = text.find(needle), 0, 0
    while at >= 0:
        seen += text.count(b" ", counted, at)
        counted = at
        out.append(seen)
        at = text.find(needle, at + 1)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: places of the base phrases and the matched blocks.

    ``doc_id, n_words, starts array<long>, base array<string>, blocks
    array<long>, block_labels array<string>, block_scores array<double>``;
    ``blocks`` are the positions of the matched blocks' first words.
    """
    prepared = prepare(token_frequencies(docs, text), containment=containment)
    rare = frozenset().union(*[t["prefix"] for t in prepared])
    phrases = {p.encode(): label for p, label in PHRASES.items()}

    def run(ids, texts) -> Iterator[tuple]:
        for key, body in zip(ids, texts, strict=True):
            flat = words(body)
            tokens = flat.split()
            everything = set(tokens)
            starts, base = [], []
            for phrase, label in phrases.items():
                if everything.issuperset(phrase.split()):
                    if found := places(b" ".join(tokens), phrase):
                        starts += found
                        base.append(label)
            hits = list(matches(flat, everything, prepared, rare))
            yield (key, len(tokens), starts, base, [h[0] for h in hits],
                   [prepared[h[1]]["label"] for h in hits], [h[2] for h in hits])

    return arrow_map(narrow(docs, doc_id=doc_id, text=text), run,
                     "doc_id long, n_words long, starts array<long>, base array<string>, "
                     "blocks array<long>, block_labels array<string>, block_scores array<double>")


def report(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, first and last place, labels and the best score."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "block_labels")).alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(
            F.coalesce(F.array_max("block_scores"), F.lit(0.0))).alias("score"))
