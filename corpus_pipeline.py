"""Corpus pipeline: documents -> cleaned, deduplicated, mixed and tokenised corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gapmeter.llm import stages
from gapmeter.session import ensure_checkpoint_dir

STAGES = [
    ("language_id", stages.language),
    ("simhash_near_dedup", stages.near_duplicates),
    ("substring_dedup", stages.substring),
    ("mixing", stages.mixture),
    ("bpe", stages.tokens),
]

#: Not expressible in SQL (learned model, link components, BPE); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
