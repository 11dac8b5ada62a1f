"""The corpus pipeline: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
run() writes each stage's result to the shared folder and reads it back for the next one; a stage's table goes when the
next one is written, and so do the tables that stages write for themselves. SQL cannot express the classifier, so
ORACLE_SQL is None; tests hold every stage against a plain version.

Nulls, empty texts, repeated rows, empty tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactspark.llm import decontamination, mixing, neardup, quality_classifier, sharding
from impactspark.llm.common import drop_table, save, scratch

ORACLE_SQL = None

#: Documents of this similarity of word shingles or more are near duplicates here.
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.keep_one(docs, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edit budget, go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document taken twice stands twice."""
    return mixing.repeat(mixing.mix(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its place in it."""
    return sharding.kd_shard(docs, leaves=16)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            new = keep(save(stage(spark, docs, sf_dir), f"stage-{name}"))
        drop_table(spark, docs)
        docs = new
    # the last stage has written what it needs of docs before it returns
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_table(spark, docs)
    return out
