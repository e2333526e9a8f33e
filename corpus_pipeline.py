"""From documents to packed training sequences: low quality goes, one document of each group of
near-duplicates stays, secrets are replaced, and what is left is tokenised and packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last return the columns of ``docs``, further ones whatever their names included. Empty tables give
empty results, NULL texts are treated as empty ones, rows without a key count like any other, and of
rows that repeat the near-duplicate stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import packing, quality_rules, secret_scan, simhash
from plumbline.llm.common import table
from plumbline.llm.queries import WORD_BPE
from plumbline.session import checkpoint

ORACLE_SQL = None
"""A trained classifier, XXH64 shingles and a tokenizer are beyond SQL; tests compare the stages with
plain code."""


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; documents without any stay as they are."""
    return secret_scan.without_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.packed_tokens(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
