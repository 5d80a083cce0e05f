"""Quality rules by line sequence labelling with a linear-chain CRF.

Every line of a document is labelled content or boilerplate by Viterbi
decoding of a two-state linear-chain conditional random field over line
features; the share of the document's characters in content lines decides
retention.

The CRF is fitted on a bounded sample of labelled documents (``labels.quality``
gives every line of a document its weak label), at most ``SAMPLE`` documents a
class, by gradient ascent on the chain's log-likelihood.  The sample's bound is
the ``sample`` parameter.  Decoding covers every whole text in one scan without
a shuffle; the weights are some forty numbers.

Defined results: null text has no words and is rejected by the base rules;
documents without any line holding a word have content share 0; repeated rows
each give their own row; an empty table gives no rows; without usable labels
the CRF keeps its prior weights; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelo.llm.common import arrow_map, bounded_sample, narrow

#: most documents of a quality class that the CRF is fitted on, all lines of each
SAMPLE = 1000
#: lines of a chain when it is fitted; a longer document is fitted as several
CHAIN_LINES = 256
SHARE = 0.5
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
FEATURES = ("bias", "short", "few words", "symbols", "many symbols", "upper", "mostly upper", "exclaims",
            "many exclaims", "digits", "repeated words", "very repeated words", "pipes", "ends sentence",
            "long words", "repeated line")


def line_features(line: bytes, seen: bool) -> list[float]:
    """Indicator features of one line; ``seen``: the same line stood earlier in the document."""
    ws = line.split()
    n = max(len(ws), 1)
    chars = max(len(line), 1)
    symbols = sum(line.count(s) for s in SYMBOLS)
    letters_up = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    digits = len(line) - len(line.translate(None, b"0123456789"))
    exclaims = line.count(b"!")
    distinct = len(set(ws)) / n
    return [1.0, float(chars < 30), float(n < 5), float(symbols > 0.1 * n), float(symbols > 0.5 * n),
            float(letters_up > 0.3 * letters), float(letters_up > 0.7 * letters and letters > 5),
            float(exclaims > 0.1 * n), float(exclaims > 0.5 * n), float(digits > 0.2 * chars),
            float(distinct < 0.7 and n >= 8), float(distinct < 0.35 and n >= 8),
            float(line.count(b"|") > 0.2 * n), float(line.rstrip()[-1:] in (b".", b"?", b"!", b":")),
            float(chars / n > 25), float(seen)]


def lines_of(body: bytes) -> list[bytes]:
    """Lines that hold a word."""
    return [line for line in body.split(b"\n") if line.strip()]


def features(lines: list[bytes]) -> np.ndarray:
    out, seen = [], set()
    for line in lines:
        out.append(line_features(line, line in seen))
        seen.add(line)
    return np.array(out, dtype=np.float64).reshape(-1, len(FEATURES))


#: weights of "boilerplate" before any label is seen: each warning sign speaks for boilerplate
PRIOR = np.array([-3, 0, 0, 1, 3, 1, 3, 1, 3, 1, 2, 3, 3, -0.5, 1, 1], dtype=np.float64)


class Chain:
    """A two-state chain: emission weights of state 1 (boilerplate) and a 2 x 2 transition matrix."""

    def __init__(self, weights: np.ndarray | None = None, transitions: np.ndarray | None = None):
        self.weights = PRIOR.copy() if weights is None else weights
        self.transitions = np.array([[0.5, -0.5], [-0.5, 0.5]]) if transitions is None else transitions

    def viterbi(self, x: np.ndarray) -> list[int]:
        """The best state of every line; ties go to content (0)."""
        emit = (x @ self.weights).tolist()
        if not emit:
            return []
        (a, b), (c, d) = self.transitions.tolist()
        best0, best1, back = 0.0, emit[0], []
        for e in emit[1:]:
            from0, from1 = best1 + c > best0 + a, best1 + d > best0 + b
            back.append((from0, from1))
            best0, best1 = (best1 + c if from0 else best0 + a), (best1 + d if from1 else best0 + b) + e
        state = int(best1 > best0)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def batch_marginals(chain: Chain, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(boilerplate) per line and expected transition counts per sequence, by forward-backward.

    ``x`` is (sequences, lines, features), padded at the end; ``mask`` marks real lines.
    """
    n, length, _ = x.shape
    emit = np.zeros((n, length, 2))
    emit[:, :, 1] = x @ chain.weights
    t = chain.transitions
    fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    fwd[:, 0] = emit[:, 0]
    for i in range(1, length):
        step = emit[:, i] + np.logaddexp(fwd[:, i - 1, :1] + t[0], fwd[:, i - 1, 1:] + t[1])
        fwd[:, i] = np.where(mask[:, i, None], step, fwd[:, i - 1])
    for i in range(length - 2, -1, -1):
        m = emit[:, i + 1] + bwd[:, i + 1]
        step = np.logaddexp(t[:, 0] + m[:, :1], t[:, 1] + m[:, 1:])
        bwd[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * mask
    joint = fwd[:, :-1, :, None] + t + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]
    pairs = np.where(mask[:, 1:, None, None], np.exp(np.minimum(joint, 0.0)), 0.0).sum(axis=1)
    return p, pairs


def fit_chain(sequences: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.5,
              l2: float = 0.002) -> Chain:
    """Gradient ascent on the mean log-likelihood; a sequence's label holds for all its lines.

    Classes weigh alike, documents of a class weigh alike; L2 pulls towards the prior.
    """
    chain = Chain()
    sizes = np.bincount([label for _, label in sequences], minlength=2) if sequences else np.zeros(2)
    if sizes.min() == 0:
        return chain
    groups: dict[int, list] = {}  # chains by their length, rounded up to a power of two
    for x, label in sequences:
        for at in range(0, len(x), CHAIN_LINES):
            part = x[at: at + CHAIN_LINES]
            groups.setdefault(1 << (len(part) - 1).bit_length(), []).append((part, label, 0.5 / sizes[label] / len(x)))
    batches = [_batch(length, parts) for length, parts in sorted(groups.items())]
    start = chain.transitions.copy()
    for _ in range(rounds):
        gw, gt = np.zeros(len(FEATURES)), np.zeros((2, 2))
        for x, mask, y, weight, observed in batches:
            p, pairs = batch_marginals(chain, x, mask)
            miss = ((y == 1)[:, None] * mask - p) * weight[:, None]
            gw += np.einsum("nl,nlf->f", miss, x)
            gt += (weight[:, None, None] * (observed - pairs)).sum(axis=0)
        chain.weights = chain.weights + rate * 8 * (gw - l2 * (chain.weights - PRIOR))
        chain.transitions = chain.transitions + rate * (gt - l2 * (chain.transitions - start))
    return chain


def _batch(length: int, parts: list[tuple[np.ndarray, int, float]]) -> tuple[np.ndarray, ...]:
    """Chains of up to ``length`` lines as arrays: features, real lines, labels, weights, observed transitions."""
    lengths = np.array([len(x) for x, _, _ in parts])
    y, weight = np.array([label for _, label, _ in parts]), np.array([w for _, _, w in parts])
    mask = np.arange(length)[None, :] < lengths[:, None]
    x = np.zeros((*mask.shape, len(FEATURES)))
    for i, (f, _, _) in enumerate(parts):
        x[i, : len(f)] = f
    observed = np.zeros((len(y), 2, 2))
    observed[np.arange(len(y)), y, y] = lengths - 1
    return x, mask, y, weight, observed


def training_sequences(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, int]]:
    """Features of all lines of at most ``sample`` labelled documents a class, chosen by a seeded hash."""
    known = narrow(labels, doc_id="doc_id", quality="quality").where("quality in (0, 1) and doc_id is not null")
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "quality", "doc_id", sample)
    texts = narrow(docs, doc_id="doc_id", text="text").where(F.length("text") > 0)
    rows = (texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text").collect())
    out = []
    for quality, text in sorted((r["quality"], r["text"]) for r in rows):
        if kept := lines_of(text.encode("utf-8", "replace")):
            out.append((features(kept), 1 - quality))
    return out


def repeat_words(ws: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more, first ones included."""
    windows = list(zip(ws, ws[1:], ws[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text",
          share: float = SHARE) -> DataFrame:
    """Base counts, the line labels and both verdicts of every document.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, line_labels array<int>, content_share, kept``; ``line_labels``
    are of the lines that hold a word, 1 marks boilerplate.
    """
    weights, transitions = chain.weights, chain.transitions

    def run(ids, texts) -> Iterator[tuple]:
        model = Chain(weights, transitions)
        for key, body in zip(ids, texts, strict=True):
            raw = (body or "").encode("utf-8", "replace")
            ws = raw.split()
            n = len(ws)
            blank = len(raw) - sum(map(len, ws))
            lines = lines_of(raw)
            repeats = repeat_words(ws)
            failed = n < 50 or 100 * repeats > 50 * n
            marks = model.viterbi(features(lines))
            content = content_share(lines, marks)
            yield (key, n, len(body or "") - blank, sum(raw.count(s) for s in SYMBOLS), len(lines) - len(set(lines)),
                   repeats, failed, marks, content, not failed and content >= share)

    return arrow_map(narrow(docs, doc_id=doc_id, text=text), run,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, line_labels array<int>, "
                     "content_share double, kept boolean")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit the chain on the bounded labelled sample."""
    return fit_chain(training_sequences(docs, labels, sample))


def keep(docs: DataFrame, chain: Chain, text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; one scan, no shuffle."""
    weights, transitions, at = chain.weights, chain.transitions, docs.columns.index(text)

    def run(batches):
        model = Chain(weights, transitions)
        for batch in batches:
            yield batch.filter(pa.array([verdict(t, model, share) for t in batch.column(at).to_pylist()],
                                        type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def verdict(body: str | None, model: Chain, share: float) -> bool:
    """Whether a text is kept: the base rules, then the share of content lines."""
    raw = (body or "").encode("utf-8", "replace")
    ws = raw.split()
    if len(ws) < 50 or 100 * repeat_words(ws) > 50 * len(ws):
        return False
    lines = lines_of(raw)
    return content_share(lines, model.viterbi(features(lines))) >= share


def content_share(lines: list[bytes], marks: list[int]) -> float:
    """Bytes of content lines among all lines' bytes; 0 without lines."""
    total = sum(map(len, lines))
    return sum(len(line) for line, m in zip(lines, marks, strict=True) if not m) / total if total else 0.0
