"""Corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Quality rules drop what they reject, near-duplicate detection keeps one document of each class, secrets are
masked, sources are mixed to their target weights (a document taken twice is two rows), and byte-level BPE encodes
what is left. All stages but the last return the columns of ``documents``; the last returns
(doc_id, n_tokens, ids_sha256, decoded_sha256).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stormlake.llm import bpe, mixing, neardup, quality, secrets
from stormlake.llm.base import discard, stored
from stormlake.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    discard("quality", unless=docs)  # the stage before has been written
    return neardup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    discard("candidates", unless=docs)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Consistent sampling, expectation-maximisation and BPE have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
