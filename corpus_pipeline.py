"""A pipeline over `documents`: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import byte_bpe, common, language_id, mixing, near_dup, secrets

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is not recognised."""
    common.prepare(spark)
    return language_id.known_language(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    common.prepare(spark)
    return near_dup.distinct_documents(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; all documents stay."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    common.prepare(spark)
    coded = common.written(byte_bpe.encode(docs, RANKS), "ids")  # else each task runs two Python workers, one for either way
    return byte_bpe.digests(byte_bpe.decode(coded, RANKS), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", recognised),
    ("minhash", distinct),
    ("secrets", redacted),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Language models, sketches and merges of byte pairs have no SQL form; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
