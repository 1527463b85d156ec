"""Corpus pipeline: stages of (name, function), each on all that the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statewell.llm import decontaminate, mixing, near_copies as copies, sharding, toxicity
from statewell.llm.base import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance rates toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: proposed by ball hashing on twelve prints of 40 bits, linked by a
    Jaccard similarity of their five-word shingles of 0.8 or more."""
    return copies.keep_first(docs, words=5, similarity=0.8)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 10 or more words of a benchmark item are cut out; documents that are mostly that go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, coverage=0.5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document can stay once, twice or not at all."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, virtual slot, shard and position in the shard."""
    return sharding.shard_documents(docs, shards=24, map_path=sharding.map_folder(spark, "pipeline", sf_dir)).select("row.*", "size", "vslot", "shard", "slot")


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: A trained dictionary, ball hashing and a balanced draw have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
