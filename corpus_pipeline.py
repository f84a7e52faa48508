"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``, and any others that are there.

Defined results: null and empty texts stay in all stages, and have no token
ids; of rows that are equal in key and text one stays, as of any group of near
duplicates; rows without a key stay, are no near duplicates and lose no
passages to others; several texts of one key are documents of their own; an
empty table, or empty labels or benchmark, is no special case; very long texts
are processed whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import bpe, decontaminate, jaccard, substring, toxicity
from veridoc.llm.common import read_table, written

#: Near-duplicate shingles and similarity of the pipeline.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs, WORDS, PERCENT)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are removed; documents that
    consist of such alone go with them."""
    return substring.dedup(docs).filter("n_removed = 0 OR text <> ''").drop("n_removed")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are removed; documents with several items go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with digests of both ways."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontaminate", remove_benchmarks),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifier nor the chunker nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
