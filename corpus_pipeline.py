"""The training-data pipeline: toxic texts go, then copies, near copies and repeated passages; the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gatewise.llm import exact, minhash, packing, suffix, toxicity
from gatewise.llm.scratch import folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the model, learned from the labels, scores as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the texts that are equal without white space."""
    return exact.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8 or more."""
    return minhash.without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out of the texts what they share in strings of 200 bytes or more."""
    return suffix.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of the texts into sequences of 2048."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("exact_dedup", copies), ("near_dedup", near_copies), ("suffix_dedup", repeats), ("packing", pack)]

#: No SQL: the toxicity model is trained.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
