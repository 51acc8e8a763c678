"""A corpus from raw documents: filtered, deduplicated and packed into training sequences.

Every stage but the last returns the columns of its input under their own names, whatever they are called, with the
values they had (the suffix stage alone changes ``text``, and ``n_chars`` with it).  Null and empty texts are judged
like any text by the two filters, are near-duplicates of nothing, and pack as the end id alone.  Rows with a null
doc_id are judged by the filters, pass both dedup stages whole, and are packed.  Of repeated rows, and of rows of one
doc_id, near_dedup keeps one.  Ties go to the smaller doc_id.  Empty tables give empty results; without labels the
filters judge by their bare curves.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import minhash, packing, quality, suffix_array, toxicity
from lattica.llm.common import settled, table, where

#: DuckDB cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models don't call toxic."""
    return where(docs, lambda d: toxicity.detect(d, table(spark, sf_dir, "labels"), keep=("doc_id", "whole_row")), "predicted = 0", "doc_id", "text")


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model calls good."""
    return where(docs, lambda d: quality.classify(d, table(spark, sf_dir, "labels")), "predicted = 1", "doc_id", "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near-duplicates of one another, the one of the smallest doc_id."""
    return minhash.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of 50 bytes or more that a document of a smaller doc_id has."""
    return suffix_array.removed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality", of_good_quality),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
