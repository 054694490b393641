"""A corpus pipeline of five operators; every stage is written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cratemill.llm import common, exactdedup, mixing, quality, simhash, tiling


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exactdedup.dedup(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
]

#: SQL cannot express the quality classifier, the SimHash fingerprints or the tiling; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written before what the stage made on its way, and what it read, is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as made:
            docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(spark, before + made[:-1])  # the last path is the stage's result
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
