"""A corpus pipeline of operators from lodestone.llm: STAGES in order, and run() over the documents of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, mixing, sharding, simhash, toxicity
from lodestone.llm.common import durable


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those scored as toxic by a model fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that benchmark passages contaminate."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often and as far as the mix to target weights takes their words."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row."""
    return sharding.shard_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", clean_toxicity), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, each to what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs


#: A trained network is no SQL; tests hold each stage against plain versions.
ORACLE_SQL = None
