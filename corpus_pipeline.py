"""The corpus pipeline: quality rules, near copies, repeated passages, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of ``documents``.

1. quality: documents that the quality rules reject go;
2. near_copies: of documents linked by five-word shingles at a Jaccard
   similarity of 0.8 or more, the one with the smallest id stays;
3. passages: strings of 50 bytes that a smaller document holds go from the text,
   and documents of which nothing is left;
4. mixing: sources are brought to their target weights by repeating documents;
5. packing: documents become sequences of at most 2048 tokens; one row a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo.llm import jaccard, mixing, packing, quality, suffixes
from allelo.llm.common import Scratch
from allelo.tables import load


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality rules keep."""
    chain = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.keep(docs, chain)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard.representatives(docs, size=5, numerator=80, denominator=100)


def stage_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that a document with a smaller id holds too."""
    return suffixes.remove(docs).withColumn("n_chars", F.length("text").cast("long"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents to meet the sources' targets."""
    return mixing.repeat(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences, with their ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality", stage_quality),
    ("near_copies", stage_near_copies),
    ("passages", stage_passages),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: the stages' models, components and packing are beyond SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
