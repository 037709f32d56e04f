"""Training-corpus pipeline: language ID, toxicity, exact dedup, near-duplicate groups, packing.

Every stage takes the rows its predecessor kept and, but for the last, gives back the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fedtab.functions.common import stage
from fedtab.llm import exact, jaccard, language, packing, toxicity

#: Near-duplicates: five-word shingles, similarity of 0.8 or more.
SHINGLE_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learned from the documents' own labels; texts of no known language go."""
    return language.keep_known(docs, language.learn(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled documents that are still there; documents judged toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return exact.keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest identifier stays."""
    return jaccard.keep_one(docs, SHINGLE_WORDS, NEAR_NUM, NEAR_DEN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, as pieces of documents."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("packing", pack)]

#: Trained models, signature trees and the packing program have no SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
