"""Corpus pipeline: documents in, sharded training mix out.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept,
read again from Parquet, and returns a DataFrame; all but the last return the
columns of documents.  Stages work on every row they get; null texts and ids,
repeated rows and empty tables pass as the operators' docstrings define.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from stratum.llm.decontaminate import drop_leaks
from stratum.llm.langid import keep_identified
from stratum.llm.mixing import mix_documents
from stratum.llm.sharding import shard_documents
from stratum.llm.simhash import drop_near_duplicates
from stratum.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no text in a language learned here go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id."""
    return drop_near_duplicates(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"), similarity=0.8, radius=20)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near-equal bytes: size, shard and slot are added."""
    return shard_documents(docs, n_shards=40)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix),
          ("shard", shard)]

#: The stages hash words with functions that SQL engines do not share; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
