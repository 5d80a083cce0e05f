"""The registered ``opN_<name>`` queries: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo.llm import (bpe, jaccard, langid, licenses, mixing, neighbours, packing, quality, resampling, scoring, search,
                        suffixes, urls)
from allelo.llm.common import held_out
from allelo.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can express it."""
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return deco


@query()
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by cross-parsing entropy; fold 0 of 5 by crc32 is held out."""
    docs = load(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.training_text(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and the CRF's verdict of every document."""
    docs = load(spark, sf_dir, "documents")
    chain = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.judge(docs, chain).drop("line_labels")


@query()
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document: base phrases and matched template blocks."""
    return licenses.report(licenses.scan(load(spark, sf_dir, "documents")))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(mixing.ORACLE)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document: weights 3, 1, 2, 150% of all words, at most 2 epochs."""
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


@query()
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    joined = jaccard.join(load(spark, sf_dir, "documents"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query()
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings that start in a smaller one too."""
    return suffixes.report(load(spark, sf_dir, "documents"))


@query()
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest fitting rule, else the character models' ratio."""
    return urls.judge(load(spark, sf_dir, "pages"))


@query()
def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between the target and the background model."""
    texts = scoring.marked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scoring.score(texts, scoring.fit(texts))


@query()
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every vector whose id is divisible by 20."""
    index = neighbours.Index(load(spark, sf_dir, "embeddings"))
    return index.search(F.col("vec_id") % 20 == 0)


@query(resampling.ORACLE)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of documents towards the benchmark's words; 10% of the longer ones are drawn."""
    out = resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.drop("n_words")


@query()
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and the text they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(load(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query(search.ORACLE)
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
