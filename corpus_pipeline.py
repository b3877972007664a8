"""A cleaning pipeline over documents: STAGES in order, each reading what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from proofmill.llm import decontaminate, linededup, mixing, paritysketch, quality
from proofmill.llm.common import shared_dir


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; sources of the documents given, weights 5, 2, 1 repeating."""
    return mixing.mixed(spark, docs)


STAGES = [
    ("quality", quality.stage),
    ("line_dedup", linededup.stage),
    ("ngram_join", paritysketch.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mix),
]

#: MinHash signatures and boosted trees have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
