"""The corpus pipeline: documents of a known language, once each, without personal data, packed for training."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opinara.llm import chunk_dedup, langid, packing, pii, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language can't be told."""
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return chunk_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates on shingles of five words: SimHash by anchors, its links checked on whole sets, then
    the pairs of that similarity that its three bits don't reach."""
    return simhash.keep_one(docs, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: each piece of each document, with its text, at its place in one of them."""
    return packing.best_fit_packing(docs, tokens=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), carry_text=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("personal data", personal_data),
    ("packing", packed),
]

#: A trained classifier and best-fit packing have no SQL form; tests/llm hold run() on a small fixture against plain versions of
#: its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
