"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all
but the last return the columns of ``documents``. No stage can be expressed in SQL that
SQL engines share (a trained network, iterated graphs, a tokenizer), so ``ORACLE_SQL`` is
None and the stages are tested against plain Python versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, decontaminate, language_id, near_dedup, pii
from plumbline.llm.common import materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.keep_known(docs, language_id.fit(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in masked.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with hashes of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("byte_bpe", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
