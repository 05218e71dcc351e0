"""From documents to token ids: language, quality, near copies, mixing, byte-level BPE.

Rows are judged one by one: a null text has no language and goes, repeated rows are copies of each other, a null id is an id
like any other and comes last in its group, null sources are one source, and extra columns stay as they are.  An empty
table gives no rows.

Each stage reads what its predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from almanac.llm import bpe, language, mixing, quality_rules, simhash
from almanac.llm.common import table
from almanac.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts of which no language has half the posterior, go."""
    return language.keep_identified(docs, VOCABULARY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base statistics, or to which a learned rule applies, go."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of their distinct five-word shingles they share 0.8 or more."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document comes once per take."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned models, shingle similarity and recursive encoding have no SQL form; tests/llm/test_pipeline.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
