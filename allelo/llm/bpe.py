"""Byte-level BPE: texts to token ids and back, by rank arrays over short words.

A text is cut at added tokens, then by the byte-level pattern into words.  A
word's ids follow from its bytes alone, so each word is merged once and kept in
a bounded cache.  The words a group of texts lacks are merged together: row
``i`` of an array holds the parts of word ``i`` side by side, a second one the
merge rank of each neighbouring pair.  One step scans every row for its least
rank (the leftmost on ties), joins that pair, deletes the boundary between its
parts by moving the rest of the row up, and looks up the two ranks that changed.
A row whose ranks are all infinite is done.  Words above ``SHORT`` bytes would
take quadratic time that way; they merge through a heap over linked parts.

A space that follows a character other than white space always starts a word,
so texts are cut there first: the pattern runs only on pieces not seen before,
and a very long text is worked through in segments.

Ids are kept as little-endian unsigned 32-bit bytes.  The file is one of the
``tokenizers`` library; settings that this module does not follow (normaliser,
other models, stripping added tokens) raise ``ValueError`` instead of giving other ids.

Defined results: a null or empty text has no ids and decodes to an empty text;
an id outside the vocabulary is skipped by decoding, bytes that are no UTF-8
become U+FFFD; repeated rows are rows of their own; null keys are kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from allelo.llm.common import arrow_map, ids_by_number, narrow

#: bytes up to which a word is merged in the rank array
SHORT = 64
#: words and pieces a worker keeps
CACHE_WORDS = 400_000
#: characters worked on together and of a segment, ids decoded together
GROUP, SEGMENT, RUN = 4 << 20, 1 << 20, 1 << 20
#: rows that a task handles at once
ROWS = 1500

#: fixed value: the pattern of byte-level pre-tokenizers
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: fixed value: marks that end a piece and are words of their own there
_MARKS = ".,;:!?"

_NONE = np.iinfo(np.int32).max
# where a space does not start a piece of its own
_ODD_SPACE = re.compile(r"\s |^ ")
_WORKER: dict = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if visible in Latin-1, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(visible))
    table = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file, with the caches of a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        added = spec.get("added_tokens") or []
        if (model.get("type") != "BPE" or spec.get("normalizer") or odd or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word"))):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        vocabulary = model["vocab"]
        characters = byte_characters()
        self.first = np.array([vocabulary[c] for c in characters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.joined = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.rank = {k: r for r, k in enumerate(keys.tolist())}
        # ranks of two bytes, where every word starts
        self.first_ranks = self.ranks(np.repeat(self.first, 256), np.tile(self.first, 256)).astype(np.int32)
        back = {c: b for b, c in enumerate(characters)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    # -- merging -----------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of every pair of ids, infinite where the pair never merges (or an id is -1)."""
        key = left << 32 | right
        if not len(self.keys):
            return np.full(np.shape(key), _NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.order[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most ``SHORT`` bytes, all rows of the rank array in lockstep."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        raw = np.zeros((len(words), width), dtype=np.int64)
        raw[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        parts = np.full((len(words), width + 1), -1, dtype=np.int64)  # one column of padding ends every row
        parts[:, :-1][inside] = self.first[raw[inside]]
        done, sizes = np.zeros((len(words), width), dtype="<u4"), np.zeros(len(words), dtype=np.int64)
        rows = np.arange(len(words))
        rank = np.full((len(words), width), _NONE, dtype=np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.first_ranks[raw[:, :-1] << 8 | raw[:, 1:]], _NONE)
        while len(rows):
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), best]
            open_ = least != _NONE
            if not open_.all():
                end = ~open_
                done[rows[end], :parts.shape[1] - 1] = np.maximum(parts[end, :-1], 0)
                sizes[rows[end]] = lengths[end]
                rows, lengths, parts, rank = rows[open_], lengths[open_], parts[open_], rank[open_]
                best, least = best[open_], least[open_]
            if not len(rows):
                break
            at = np.arange(len(rows))
            # delete the boundary: parts behind the pair's left one move up by a place
            column = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, column + (column > best[:, None]), axis=1)
            parts[at, best] = self.joined[least]
            lengths = lengths - 1
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column > best[:, None]), axis=1)
            here = np.minimum(best, rank.shape[1] - 1)
            rank[at, here] = self.ranks(parts[at, here], parts[at, here + 1])
            before = np.maximum(best - 1, 0)
            rank[at, before] = self.ranks(parts[at, before], parts[at, before + 1])
        ids = done[np.arange(width) < sizes[:, None]].tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one long word: a heap of (rank, place) over linked parts."""
        parts = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        get = self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # the pair at i may have changed since it was queued
            if parts[i] < 0 or j < 0 or get(parts[i] << 32 | parts[j]) != r:
                continue
            parts[i], parts[j] = int(self.joined[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (s := get(parts[a] << 32 | parts[after[a]])) is not None:
                    heapq.heappush(heap, (s, a))
        return np.array([p for p in parts if p >= 0], dtype="<u4").tobytes()

    def merged(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words."""
        out, short = {}, []
        for word in words:
            if len(word) <= SHORT:
                short.append(word)
            else:
                out[word] = self.merge_long(word)
        short.sort(key=len)
        for k in range(0, len(short), 20_000):
            block = short[k:k + 20_000]
            out.update(zip(block, self.merge(block), strict=True))
        return out

    def learn(self, words: set[str], pieces: set[str]) -> None:
        """Ids of words, and of pieces that follow a space each, into the caches.

        A piece of letters, with or without a mark at its end, needs no pattern.
        """
        letters, tailed, cut = set(), [], {}
        for piece in pieces:
            if piece.isalpha():
                letters.add(piece)
            elif piece[-1:] in _MARKS and (core := piece[:-1]).isalpha():
                tailed.append((piece, core))
                letters.add(core)
            else:
                cut[piece] = self.pattern.findall(" " + piece)
        words = words.union(_MARKS, *cut.values())
        fresh = {" " + p: p for p in letters if p not in self.pieces}
        merged = self.merged({w.encode() for w in itertools.chain(fresh, (w for w in words if w not in self.words))})
        for word, piece in fresh.items():
            self.pieces[piece] = merged[word.encode()]
        for word in words:
            if word not in self.words:
                self.words[word] = merged[word.encode()]
        word = self.words.__getitem__
        for piece, parts in cut.items():
            self.pieces[piece] = b"".join(map(word, parts))
        for piece, core in tailed:
            self.pieces[piece] = self.pieces[core] + word(piece[-1])

    # -- texts -------------------------------------------------------------

    def segments(self, text: str) -> Iterator[str | bytes]:
        """A text's added tokens as id bytes and what lies between, in pieces of about ``SEGMENT`` characters."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                yield self.added[part].to_bytes(4, "little")
                continue
            start = 0
            while len(part) - start > SEGMENT:
                end = part.find(" ", start + SEGMENT)
                while end > 0 and part[end - 1].isspace():
                    end = part.find(" ", end + 1)
                if end < 0:
                    break
                yield part[start:end]
                start = end
            if start < len(part):
                yield part[start:]

    def plan(self, segment: str) -> tuple[list[str], str | None]:
        """Words of a segment's irregular front, and the rest, whose pieces follow a space each."""
        if _ODD_SPACE.search(segment):
            if segment[0] != " " or _ODD_SPACE.search(segment, 1):
                return self.pattern.findall(segment), None
            return [], segment[1:]
        head, space, rest = segment.partition(" ")
        return self.pattern.findall(head), rest if space else None

    def encode_group(self, group: list[list]) -> Iterator[bytes]:
        """Ids of texts given as lists of id bytes and (words, rest).

        All rests are split and numbered by Arrow; only distinct pieces are looked up, and their
        ids are gathered by number.
        """
        planned = [s for text in group for s in text if not isinstance(s, bytes)]
        split = pc.split_pattern(pa.array([rest for _, rest in planned], type=pa.large_string()), " ")
        distinct, held = [], []

        def lookup(pieces: list[str]) -> list[bytes]:
            self.learn({w for words, _ in planned for w in words}, {p for p in pieces if p not in self.pieces})
            distinct[:], held[:] = pieces, map(self.pieces.__getitem__, pieces)
            return held

        raw, cuts = ids_by_number(split, lookup)
        word, spans = self.words.__getitem__, iter(itertools.pairwise(cuts))
        for text in group:
            parts = []
            for s in text:
                if isinstance(s, bytes):
                    parts.append(s)
                else:
                    a, b = next(spans)
                    parts += [*map(word, s[0]), raw[a:b]]
            yield b"".join(parts)
        if len(self.pieces) > CACHE_WORDS:  # what this group needed stays, with it all that is frequent
            self.pieces = dict(zip(distinct, held, strict=True))
        if len(self.words) > CACHE_WORDS:
            self.words = {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of every text; about ``GROUP`` characters are worked on together.

        A text of more segments than a group holds passes through several groups.
        """
        group, size, front = [[]], 0, b""
        for text in texts:
            for segment in self.segments(text or ""):
                group[-1].append(segment if isinstance(segment, bytes) else self.plan(segment))
                size += len(segment)
                if size >= GROUP:
                    *whole, last = self.encode_group(group)
                    if whole:
                        yield front + whole[0]
                        yield from whole[1:]
                        front = b""
                    group, size, front = [[]], 0, front + last
            group.append([])
        ids = list(self.encode_group(group[:-1]))
        if ids:
            yield front + ids[0]
            yield from ids[1:]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        raw = []
        for k in range(0, len(ids), 4 * RUN):
            run = np.frombuffer(ids[k:k + 4 * RUN], dtype="<u4").tolist()
            try:
                raw.append(b"".join(map(table.__getitem__, run)))
            except KeyError:
                raw.append(b"".join(table.get(i, b"") for i in run))
        return b"".join(raw).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The worker's codec of a file; its caches serve all tasks of the worker."""
    if path not in _WORKER:
        _WORKER[path] = Codec(path)
    return _WORKER[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens long, ids binary)`` of every row; ids are little-endian unsigned 32-bit."""
    def run(keys, texts):
        for k, ids in zip(keys, codec(path).encode(texts), strict=True):
            yield k, len(ids) // 4, ids

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(narrow(docs, key=key, text=text), run, f"`{key}` {kind}, n_tokens long, ids binary", ROWS)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, n_tokens, ids, decoded string)``: the text of every row's ids."""
    def run(keys, runs):
        for k, row in zip(keys, runs, strict=True):
            yield k, len(row or b"") // 4, row, codec(path).decode(row or b"")

    kind = encoded.schema[key].dataType.simpleString()
    return arrow_map(narrow(encoded, key=key, ids=ids), run,
                     f"`{key}` {kind}, n_tokens long, ids binary, decoded string", ROWS)
