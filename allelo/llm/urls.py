"""URL filters: allow and block rules, and a ratio of character language models beyond them.

A rule is a host and a path prefix (``example.org/es/``); it fits its host and
all subdomains where the url's path starts with the rule's, and the longest
fitting rule decides.  Urls that no rule fits are judged by two smoothed
variable-order Markov models over characters, one of accepted and one of
rejected urls: a url is accepted if its log-likelihood difference per character
reaches a threshold calibrated on part of the labelled urls.

The models count every distinct labelled url (one that a rule decides), in Spark;
four fifths of them by hash give the models, the rest, all scored, the threshold.
``judge`` keeps every context: the models are a table of the runs of characters that
occur in any url, with the two models' log-ratio (``log_ratios``).  Urls are dealt into
chunks of ``CHUNK`` rows; a chunk asks the table once for each distinct run it holds and
scores its urls from the answer, so neither the driver nor a task holds a whole model.
Scores are counted to four decimals for the threshold.  ``fit`` gives the same models as
objects on the driver, for tables that are small enough.

Smoothing is Witten-Bell interpolation down to a uniform distribution over
``ALPHABET`` characters: ``p(c | ctx) = (count + t * p(c | shorter)) / (n + t)``,
``t`` being the number of distinct characters seen after the context.

Defined results: a null url or one without ``://`` has empty host and path and
no rule; a null url is blocked, any other text is scored; without labelled urls of
both classes every url that no rule decides is allowed; repeated rows each give their own row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelo.llm.common import Scratch, arrow_map, narrow

# The rules of the registered query as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

ORDER, ALPHABET = 5, 256
#: rows whose urls are scored together
CHUNK = 10_000
#: urls whose character runs a task counts together
COUNTED = 2_000
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _SMALL), path


def decided(pages: DataFrame, rules=None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, by_rule``: what the longest fitting rule says, null without one."""
    host, path = parts(F.col("url"))
    out = narrow(pages, page_id=page_id, url=url).withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules or RULES, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("by_rule", verdict)


def character_runs(urls: Iterable[str], order: int) -> Counter:
    """How often every run of up to ``order`` characters and the one after them occurs."""
    counts: Counter = Counter()
    for url in urls:
        text = "^" * order + url + "$"
        counts.update(text[i - n:i + 1] for i in range(order, len(text)) for n in range(order + 1))
    return counts


class Markov:
    """Smoothed variable-order Markov model of url characters."""

    def __init__(self, urls: Iterable[str] = (), order: int = ORDER, counts: dict[str, dict[str, int]] | None = None):
        """From urls, or from the ``counts`` of the characters that follow each context."""
        self.order = order
        if counts is None:
            counts = defaultdict(dict)
            for run, n in character_runs(urls, order).items():
                counts[run[:-1]][run[-1]] = n
        # seen (context, character) pairs get their probability; contexts their weight for the shorter one
        self.seen: dict[str, float] = {}
        self.back: dict[str, float] = {}
        for context in sorted(counts, key=len):
            following = counts[context]
            total, kinds = sum(following.values()), len(following)
            self.back[context] = math.log(kinds / (total + kinds))
            for c, n in following.items():
                shorter = math.exp(self.log(context[1:], c)) if context else 1 / ALPHABET
                self.seen[context + c] = math.log((n + kinds * shorter) / (total + kinds))

    def log(self, context: str, c: str) -> float:
        """Log-probability of ``c`` after ``context``."""
        penalty = 0.0
        while (found := self.seen.get(context + c)) is None:
            penalty += self.back.get(context, 0.0)
            if not context:
                return penalty - math.log(ALPHABET)
            context = context[1:]
        return penalty + found

    def mean(self, url: str) -> float:
        """Mean log-probability of the url's characters, its end included."""
        text = "^" * self.order + url + "$"
        return sum(self.log(text[i - self.order:i], text[i]) for i in range(self.order, len(text))) / (len(url) + 1)


def calibrate(scores: list[tuple]) -> float:
    """The threshold with the least balanced error; ``score >= threshold`` accepts.

    ``scores`` holds (score, accepted) or (score, accepted, number of such urls).
    """
    scores = [(s, ok, *(n or [1])) for s, ok, *n in scores]
    good, bad = sum(n for _, ok, n in scores if ok), sum(n for _, ok, n in scores if not ok)
    if not good or not bad:
        return 0.0
    best, best_error = 0.0, 2.0
    missed, passed = 0.0, 1.0  # of accepted urls below, of rejected ones at or above the threshold
    previous = None
    for score, ok, n in sorted(scores) + [(math.inf, True, 1)]:
        if score != previous and missed + passed < best_error - 1e-12:
            best_error = missed + passed
            best = score if previous is None or score == math.inf else (previous + score) / 2
        previous = score
        missed, passed = (missed + n / good, passed) if ok else (missed, passed - n / bad)
    return best if best != math.inf else previous


def _counted(urls: DataFrame, order: int, most: int | None) -> dict[str, dict[str, dict[str, int]]]:
    """By class: what follows each context in all of ``url, by_rule``; with ``most`` for the contexts seen most often."""
    def run(verdicts, texts) -> Iterator[tuple]:
        for verdict in set(verdicts):
            of = character_runs((t for v, t in zip(verdicts, texts, strict=True) if v == verdict), order)
            for chars, n in of.items():
                yield verdict, chars[:-1], chars[-1], n

    runs = arrow_map(urls.select("by_rule", "url"), run, "by_rule string, context string, next string, n long", COUNTED)
    follows = runs.groupBy("by_rule", "context", "next").agg(F.sum("n").alias("n")).groupBy("by_rule", "context").agg(
        F.sum("n").alias("seen"), F.collect_list("next").alias("next"), F.collect_list("n").alias("n"))
    scratch = Scratch(urls.sparkSession, "urls")
    follows = scratch.write(follows, "follows")
    kept = F.lit(True)
    if most is not None:
        kept = _most_seen(follows, most)
    out: dict[str, dict[str, dict[str, int]]] = {"allow": {}, "block": {}}
    for r in follows.where(kept).drop("seen").toLocalIterator():
        out[r["by_rule"]][r["context"]] = dict(zip(r["next"], r["n"], strict=True))
    scratch.drop("follows")
    return out


def _most_seen(follows: DataFrame, most: int) -> Column:
    """Whether a context is among the at most ``most`` of its class that are seen most often."""
    least: dict[str, int] = {}
    left = {"allow": most, "block": most}
    for r in follows.groupBy("by_rule", "seen").count().orderBy(F.col("seen").desc()).collect():
        if left[r["by_rule"]] >= r["count"]:
            least[r["by_rule"]] = r["seen"]
            left[r["by_rule"]] -= r["count"]
        else:
            left[r["by_rule"]] = 0
    kept = F.lit(False)
    for verdict, seen in least.items():
        kept = kept | ((F.col("by_rule") == verdict) & (F.col("seen") >= seen))
    return kept


def _held() -> Column:
    """True for the urls that give the threshold; null for a null url."""
    return F.crc32(F.col("url").cast("binary")) % 5 == 0


def fit(labelled: DataFrame, contexts: int | None = None, order: int = ORDER):
    """(accepted model, rejected model, threshold) from ``url, by_rule``; None if a class is missing.

    Four fifths of the distinct urls give the models, every fifth by hash the threshold.  The
    models are whole unless ``contexts`` bounds them, and they come to the driver.
    """
    distinct = labelled.where("by_rule is not null").select("url", "by_rule").distinct()
    held = _held()
    counts = _counted(distinct.where(~held), order, contexts)
    if not counts["allow"] or not counts["block"]:
        return None
    accepted, rejected = (Markov(order=order, counts=counts[v]) for v in ("allow", "block"))

    def run(verdicts, texts) -> Iterator[tuple]:
        for verdict, text in zip(verdicts, texts, strict=True):
            yield round(accepted.mean(text) - rejected.mean(text), 4), verdict == "allow"

    scores = arrow_map(distinct.where(held).select("by_rule", "url"), run, "score double, accepted boolean")
    return accepted, rejected, calibrate([tuple(r) for r in scores.groupBy("score", "accepted").count().collect()])


def _grams(url: str, order: int) -> list[str]:
    """The run of ``order`` characters and the one after them, at every character and at the end."""
    text = "^" * order + url + "$"
    return [text[i:i + order + 1] for i in range(len(url) + 1)]


def _gram_counts(urls: DataFrame, order: int) -> DataFrame:
    """``gram, allow, block``: how often each gram occurs in the accepted and rejected ones of ``url, by_rule``."""
    def run(verdicts, texts) -> Iterator[tuple]:
        counts = defaultdict(lambda: [0, 0])
        for verdict, text in zip(verdicts, texts, strict=True):
            for gram in _grams(text, order):
                counts[gram][verdict != "allow"] += 1
        for gram, (allow, block) in counts.items():
            yield gram, allow, block

    counts = arrow_map(urls.select("by_rule", "url"), run, "gram string, allow long, block long", COUNTED)
    return counts.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio``: log-probability of a gram's last character after the others, accepted less rejected model.

    ``grams`` holds the labelled counts ``allow, block`` of every gram that is asked for, zeros
    included.  The counts of shorter runs are sums over the grams that end in them, and each
    length's probabilities build on those of the length below, as ``Markov`` does.
    """
    shorter = None
    for size in range(1, order + 2):
        level = grams.groupBy(F.right("gram", F.lit(size)).alias("run")).agg(F.sum("allow").alias("allow"),
                                                                            F.sum("block").alias("block"))
        same = Window.partitionBy(F.left("run", F.lit(size - 1)))  # at most a row a character
        level = level.select("run", *[c.alias(name) for v in ("allow", "block") for name, c in (
            (v, F.col(v)), (f"total_{v}", F.sum(v).over(same)), (f"kinds_{v}", F.count_if(F.col(v) > 0).over(same)))])
        if shorter is None:
            level = level.withColumns({f"p_{v}": F.lit(1 / ALPHABET) for v in ("allow", "block")})
        else:
            level = level.withColumn("rest", F.right("run", F.lit(size - 1))).join(
                shorter.withColumnRenamed("run", "rest"), "rest")
        found = [F.when(F.col(f"total_{v}") > 0, (F.col(v) + F.col(f"kinds_{v}") * F.col(f"p_{v}")) / (
            F.col(f"total_{v}") + F.col(f"kinds_{v}"))).otherwise(F.col(f"p_{v}")).alias(f"p_{v}") for v in ("allow", "block")]
        shorter = level.select("run", *found)
    return shorter.select(F.col("run").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def _scored(rows: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """``rows`` with the ``score`` of their urls; ``asked(chunk, gram, ratio)`` has all grams of a chunk."""
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        ratio = dict(zip(answers["gram"].to_pylist(), answers["ratio"].to_pylist(), strict=True)) if len(answers) else {}
        scores = [None if u is None else sum(map(ratio.__getitem__, _grams(u, order))) / (len(u) + 1)
                  for u in group["url"].to_pylist()]
        return group.append_column("score", pa.array(scores, type=pa.float64()))

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "score double"])
    return rows.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, schema)


def judge(pages: DataFrame, rules=None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; ``score`` is the models' difference per character."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = scratch.write(decided(pages, rules, page_id, url).withColumn("page_id", F.col("page_id").cast("long"))
                         .withColumn("chunk", F.expr(f"monotonically_increasing_id() div {CHUNK}")), "rows")
    labelled = rows.where("by_rule is not null and url is not null")
    trained = labelled.where(~_held()).select("url", "by_rule").distinct()

    def run(chunks, texts) -> Iterator[tuple]:
        held = defaultdict(set)
        for number, text in zip(chunks, texts, strict=True):
            held[number].update(_grams(text, ORDER))
        for number, grams in held.items():
            for gram in grams:
                yield number, gram

    asked = scratch.write(arrow_map(rows.where("url is not null").select("chunk", "url"), run, "chunk long, gram string"), "asked")
    every = _gram_counts(trained, ORDER).unionByName(asked.select("gram", *[F.lit(0).cast("long").alias(v) for v in ("allow", "block")]))
    grams = scratch.write(every.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "grams")
    threshold, scored = 0.0, rows.withColumn("score", F.lit(None).cast("double"))
    seen = grams.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if seen["allow"] and seen["block"]:
        answers = asked.join(log_ratios(grams), "gram")
        scored = scratch.write(_scored(rows, answers, ORDER), "scored")
        checked = scored.where("by_rule is not null and url is not null").where(_held()).select("url", "by_rule", "score").distinct()
        counts = checked.groupBy(F.bround("score", 4).alias("score"), (F.col("by_rule") == "allow").alias("accepted")).count()
        threshold = calibrate([tuple(r) for r in counts.collect()])
        scratch.drop("rows")
    scratch.drop("asked", "grams")
    passes = F.col("url").isNotNull() & (F.col("score").isNull() | (F.col("score") >= threshold))
    verdict = F.coalesce("by_rule", F.when(passes, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
