"""JSON lines of {id, text[, title]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(ext_id, title, text), with a given schema so that nothing is read twice."""
    rows = spark.read.schema("id string, text string, title string").json(path)
    return rows.select(F.col("id").alias("ext_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
