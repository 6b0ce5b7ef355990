"""From raw documents to token ids: quality, near-duplicates, personal data, mix, encoding.

Stages read doc_id, text and source; further columns travel along, whatever
they are called. Every stage but the last returns the columns it was given.
An empty table gives an empty table at every stage. Texts count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.llm import byte_bpe, mixing, pii, quality_classifier, shingles
from samplewright.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts score the labels' mean, so they stay or go with it; equal
    rows score alike. Without labels all score 0.5 and stay.
    """
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are alike to 0.8 or more.

    The one with the smallest id stays, a null id counting as larger than all; of
    equal ids the one with the smallest hash, of wholly equal rows one. Null, empty
    and blank texts are one group.
    """
    return shingles.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; null texts stay null, others whole but for the spans."""
    return _counted(pii.without_pii(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, a row for each pass that takes any of its words.

    Null, empty and blank texts have no words and are not taken; a null source is a
    source of its own; repeated rows are mixed each on its own.
    """
    return _counted(mixing.mixed_texts(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids of every document; null texts count as empty."""
    return byte_bpe.digests(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where they have it, brought up to date."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("mixing", mixed), ("byte_bpe", encoded)]

#: SQL cannot express the stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
