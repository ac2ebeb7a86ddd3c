"""The corpus pipeline: quality filter, near-duplicate removal, PII surrogates, source mixing, sampled pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Empty tables pass through every stage; nulls, ties and repeated rows follow each operator's own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import mixing, near_copies, pii, quality, sentencepiece_sampling, simhash
from panelforge.llm.common import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled ones, does not reject."""
    return quality.good_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of op3: fingerprints within two bits."""
    return simhash.deduplicated(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the classes of op3, then similarity 0.8 over five-word shingles."""
    return near_copies.without_near_copies(stored(near_duplicates(spark, docs, sf_dir)))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced."""
    return pii.with_surrogates(docs).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.mix_documents(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled segmentation of every document, checked to decode to its text."""
    return sentencepiece_sampling.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", one_of_near_copies),
    ("pii surrogates", pii_surrogates),
    ("source mixing", source_mix),
    ("sentencepiece", sampled_pieces),
]
#: Neither a fitted field nor sampled segmentations have a SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
