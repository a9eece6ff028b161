"""The cleaning pipeline over `documents`: each stage is one operator, reads what the stage before it kept, and takes effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet to the shared folder and gives it, read again, to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readlens.llm import bpe, decontam, neardup, pii, queries, toxicity
from readlens.session import Stages, ship

#: SQL can express neither the learned toxicity scores nor Order MinHash; the tests compare run() with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.remove(docs, labels, queries.toxic_fold)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id."""
    return neardup.deduplicate(docs, queries.SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain an item of the benchmark."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), queries.SIMILARITY)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind in brackets."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them, of every document."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """A stage may be run by itself, so each makes sure that executors have the package."""
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _shipped(drop_toxic)),
    ("near_dedup", _shipped(drop_near_copies)),
    ("decontamination", _shipped(drop_benchmark)),
    ("pii", _shipped(redact_pii)),
    ("byte_bpe", _shipped(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
