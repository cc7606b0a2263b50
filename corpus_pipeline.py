"""From raw documents to token ids in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plcatlas.llm import bpe, exact_dedup, language, mixture, ngram_join
from plcatlas.llm.common import written
from plcatlas.llm.queries import LEARN_FROM, PATTERN

LEAST_SCORE = 0.3
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# A trained language model has no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the tagger tells with some certainty, go."""
    return language.keep_known(docs, language.train(docs, LEARN_FROM), LEAST_SCORE)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.distinct_texts(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts (five-word shingles, similarity of 0.8 or more) the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text's tokens."""
    return bpe.encode(docs, bpe.read_ranks(VOCABULARY), PATTERN)


STAGES = [
    ("language", known_language), ("exact_dedup", distinct_texts), ("ngram_join", distinct_shingles), ("mix", mixed_sources), ("encode", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
