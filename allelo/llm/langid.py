"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text.  A document
is parsed greedily against it: each phrase is the longest prefix of the rest
that occurs in the training text.  ``c`` phrases over ``n`` characters estimate
the cross entropy as ``c * (log2(N) + log2(A)) / n`` bits a character: a phrase is a place
in the training text of ``N`` characters and the character, one of ``A``, that ends the
match (``N`` is at least the root of the longest training text's length).  The language with the
fewest normalised phrases wins, ties go to the smaller code.

The training text is a bounded sample (``sample_docs`` documents and
``sample_chars`` characters a language, ``all_chars`` in all languages together),
seeded pieces from anywhere in documents chosen by a seeded hash among
labelled documents outside the held-out fold.  The automata are rebuilt in each
Python worker from that text and turned into one transition table, so the
greedy parse of many documents runs in lockstep, one character a step.  A phrase
does not cross a block border of ``BLOCK`` characters; this bounds a task's
memory and steps for texts of any length while every character is parsed.

Defined results: null text, or text without a letter, is ``und`` with score 0;
without any labelled text every document is ``und``; repeated rows each give
their own row; a null id is not held out and never learned from; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelo.llm.common import arrow_map, bounded_sample, held_out, narrow

#: documents a language learns from, characters of a language, and of all languages together
SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS = 60, 40_000, 800_000
BLOCK = 4096
#: characters scored in lockstep at a time; bounds a task's memory
GROUP_CHARS = 4_000_000

_CACHE: dict = {}


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for ch in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def normalise(text: str) -> str:
    """Lower case; every run of other characters than letters becomes one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


class Parser:
    """All languages' automata as one table over a shared alphabet."""

    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        letters = sorted(set("".join(training.values())) - {" "})
        self.codes = {ord(c): i + 2 for i, c in enumerate(letters)}  # 0: unseen letter, 1: blank
        width = len(letters) + 2
        self.width = width
        tables, self.roots, self.bits = [], [], []
        least = max(math.sqrt(max(map(len, training.values()))), 2.0)
        base = 0
        for lang in self.langs:
            nxt = suffix_automaton(training[lang])
            root = np.full(width, base, dtype=np.int64)
            code = {c: (1 if c == " " else self.codes[ord(c)]) for c in set(training[lang])}
            for c, target in nxt[0].items():
                root[code[c]] = base + target
            # a missing transition ends the phrase and starts the next one with this character
            table = np.tile(root * 2 * width + 1, (len(nxt), 1))
            for state, edges in enumerate(nxt):
                row = table[state]
                for c, target in edges.items():
                    row[code[c]] = (base + target) * 2 * width
            tables.append(table)
            self.roots.append(base * width)
            # a phrase costs a place in the training text and the character that ends the match; the floor keeps
            # a language of a few labelled letters, where every phrase is a letter, from winning unlike texts
            self.bits.append(math.log2(max(len(training[lang]), least)) + math.log2(width))
            base += len(nxt)
        # an entry is 2 * width * state + (1 where a phrase ends)
        self.table = np.concatenate(tables).reshape(-1)
        if self.table.max() < 2**31:
            self.table = self.table.astype(np.int32)
        # code of every code point: an unseen letter's is 0, that of all else 1
        self.lookup = np.array([not chr(cp).isalpha() for cp in range(0x110000)], dtype=np.uint16)
        for cp, code in self.codes.items():
            self.lookup[cp] = code

    def encode(self, text: str) -> np.ndarray:
        """Letter codes with runs of blanks joined."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.lookup[points]
        blank = codes == 1
        blank[1:] &= blank[:-1]
        blank[:1] = False
        return codes[~blank]

    def phrases(self, codes: np.ndarray) -> np.ndarray:
        """Phrases of one code sequence per language: the reference parse, block by block."""
        out = np.zeros(len(self.langs), dtype=np.int64)
        for i, root in enumerate(self.roots):
            for at in range(0, len(codes), BLOCK):
                state, count = root, 1
                for c in codes[at: at + BLOCK].tolist():
                    v = int(self.table[state + c])
                    count += v & 1
                    state = v >> 1
                out[i] += count
        return out

    def phrases_many(self, sequences: list[np.ndarray]) -> np.ndarray:
        """(sequences, languages) phrase counts, all blocks in lockstep."""
        owners, blocks = [], []
        for i, s in enumerate(sequences):
            for at in range(0, len(s), BLOCK):
                owners.append(i)
                blocks.append(s[at: at + BLOCK])
        out = np.zeros((len(sequences), len(self.langs)), dtype=np.int64)
        if not blocks:
            return out
        lengths = np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        grid = np.zeros((int(lengths[0]), len(blocks)), dtype=self.table.dtype)
        for lane, i in enumerate(order.tolist()):
            grid[: len(blocks[i]), lane] = blocks[i]
        alive = len(blocks) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        state = np.repeat(np.array(self.roots, dtype=self.table.dtype)[:, None], len(blocks), axis=1)
        ends = np.ones(state.shape, dtype=np.int32)
        for step in range(int(lengths[0])):
            n = int(alive[step])
            v = self.table[state[:, :n] + grid[step, :n]]
            ends[:, :n] += v & 1
            state[:, :n] = v >> 1
        np.add.at(out, np.array(owners)[order], ends.T)
        return out


def _parser(training: dict[str, str]) -> Parser:
    key = hash(tuple(sorted(training.items())))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Parser(training)
    return _CACHE[key]


def training_text(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
                  all_chars: int = ALL_CHARS) -> dict[str, str]:
    """Labelled text per language: a bounded sample outside the held-out fold.

    At most ``sample_docs`` documents a language, chosen by a seeded hash; of each a piece that
    starts at a seeded place anywhere in it.  A language gets ``sample_chars`` characters, or its
    part of ``all_chars`` where there are many languages; if its pieces have more in all, every
    one is shortened alike.
    """
    learnable = (narrow(docs, doc_id="doc_id", text="text", lang="lang")
                 .where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike("\\p{L}"))
                 .where(~held_out(F.col("doc_id"))))
    piece = 2 * sample_chars // sample_docs
    start = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id")), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1
    cut = learnable.select("doc_id", "lang", F.col("text").substr(start.cast("int"), F.lit(piece)).alias("text"))
    rows = bounded_sample(cut, "lang", "doc_id", sample_docs).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        texts.setdefault(r["lang"], []).append(normalise(r["text"]))
    most = min(sample_chars, all_chars // max(len(texts), 1))
    out = {}
    for lang, parts in texts.items():
        share = min(1.0, most / sum(map(len, parts)))
        out[lang] = "".join(p[:max(int(len(p) * share), 1)] for p in parts)
    return {lang: text for lang, text in out.items() if text.strip()}


def identify(docs: DataFrame, training: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits`` of every whole text.

    ``bits`` is the winner's cross entropy a character; ``score`` is how far
    below the runner-up it lies: 1 - best / second (1 with a single language).
    """
    def run(ids, texts) -> Iterator[tuple]:
        parser = _parser(training) if training else None
        pending, size = [], 0
        for key, body in zip(ids, texts, strict=True):
            codes = parser.encode(body) if parser and body else None
            if codes is None or not (codes != 1).any():
                yield key, "und", 0.0, None
                continue
            pending.append((key, codes))
            size += len(codes)
            if size > GROUP_CHARS:
                yield from decide(parser, pending)
                pending, size = [], 0
        if pending:
            yield from decide(parser, pending)

    return arrow_map(narrow(docs, doc_id=doc_id, text=text), run,
                     "doc_id long, lang_pred string, score double, bits double")


def decide(parser: Parser, pending: list[tuple]) -> Iterator[tuple]:
    """The winning language of each (key, codes)."""
    bits = parser.phrases_many([c for _, c in pending]) * np.array(parser.bits)
    for (key, codes), h in zip(pending, bits, strict=True):
        best = int(np.argmin(h))
        rest = np.delete(h, best)
        score = 1.0 - float(h[best] / rest.min()) if len(rest) else 1.0
        yield key, parser.langs[best], score, float(h[best] / len(codes))
