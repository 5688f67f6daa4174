"""The corpus pipeline: quality, repetition, near copies, mixing, packing. Each stage reads what the one before kept.

An empty table gives an empty one at every stage. Further columns pass through all stages but the last, whatever their
names; null sources and null doc_ids are values like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papergrove.llm import jaccard, mixing, ordinal, packing, repetition
from papergrove.llm.queries import SEQUENCE, VOCABULARY
from papergrove.llm.runtime import drop, prepare, stage

#: No document is left out by mixing; the most repeated source is seen this often at most.
MIX = mixing.Mix(least_entropy=0.95, most_passes=1.5, budget=None)
#: Documents of a sequence at most.
MOST_DOCS = 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade over 0 is at least one half.

    Null and empty texts are judged by the features of a text without words; repeated rows alike, and a probability of
    one half stays.
    """
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return ordinal.classify(spark, docs, ordinal.train(spark, docs, ordinal.graded(labels)), keep_rows=True)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits on repeated passages.

    Null, empty and short texts (under 50 words) fail the base rule; repeated rows are judged alike, and what is at a
    limit stays.
    """
    return repetition.repetition_rules(spark, docs, keep_rows=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words with Jaccard of 0.8 and more.

    It is that of the least doc_id (null last), then of the text's hash; of equal rows one stays. Texts without words
    are linked with nothing and all stay.
    """
    return jaccard.keep_one(spark, docs, 5, 80, 100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered weights of their source ask; none is left out.

    A null or empty text counts as one token; repeated rows are drawn each; hash order decides which documents a last,
    partial pass reaches, and equal rows share their draws.
    """
    return mixing.mix_rows(prepare(spark), docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens and MOST_DOCS pieces.

    A null or empty text is its end id alone; repeated rows are packed each; equal lengths go by doc_id and piece.
    """
    return packing.pack_documents(spark, docs, VOCABULARY, SEQUENCE, most_docs=MOST_DOCS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("rules", rules),
    ("near_copies", near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: Tokenizing and hashing cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written as Parquet, read again, and deleted after the next."""
    docs, was = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        docs, last = stage(spark, step(spark, docs, sf_dir), name), was
        if last is not None:
            drop(spark, last)
        was = docs
    return docs
