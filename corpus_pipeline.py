"""The corpus pipeline: toxicity, near duplicates, benchmark overlap, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. Stages follow each
other in the same executors, whose workers keep the memory that the largest
batch took, so every stage takes small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfstream.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from shelfstream.llm.common import read, small_batches
from shelfstream.scale import fresh_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the grammar scores as toxic go; it learns from the labelled rows among them."""
    return toxicity.drop_toxic(small_batches(docs), toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at five words and 0.8 that with the least doc_id stays."""
    return ngram_join.keep_one(small_batches(docs), percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.drop_contaminated(small_batches(docs), read(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the domains' tokens meet their targets."""
    return mixing.apply_mix(small_batches(docs), read(spark, sf_dir, "labels"))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its slot and shard; a shard's rows lie together."""
    return sharding.deal(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
    ("sharding", deal_shards),
]

# The learned stages can't be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's output stored in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
