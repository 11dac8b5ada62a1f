"""Vocabularies: position is the term id. Files of one token a line, JSON arrays, DataFrames, and their hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactspark.functions.tokenizer import MAX_TOKEN_BYTES

MAX_FILE_BYTES = 256 << 20


def check_tokens(tokens: list[str]) -> list[str]:
    """Tokens that are unique, not empty and short enough; anything else is an error that names the place."""
    if not tokens:
        raise ValueError("the vocabulary is empty")
    seen: set[str] = set()
    for i, t in enumerate(tokens):
        if not t:
            raise ValueError(f"vocabulary token {i} is empty")
        if t in seen or len(t.encode()) > MAX_TOKEN_BYTES:
            raise ValueError(f"vocabulary token {i} is duplicate or too long")
        seen.add(t)
    return tokens


def read_vocab_file(path: str) -> list[str]:
    """Tokens of a text file, in order; carriage returns and newlines at the end don't count."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"cannot open {path}")
    if not 1 <= p.stat().st_size <= MAX_FILE_BYTES:
        raise ValueError("the vocabulary is empty or too large")
    return check_tokens(p.read_text(encoding="utf-8").replace("\r", "").rstrip("\n").split("\n"))


def vocab_json(tokens: list[str]) -> str:
    return json.dumps(tokens, ensure_ascii=False)


def parse_vocab_json(text: str) -> list[str]:
    got = json.loads(text)
    if not isinstance(got, list) or not all(isinstance(t, str) for t in got):
        raise ValueError("a vocabulary must be a JSON array of strings")
    return got


def vocab_frame(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """(term int, token string)."""
    if not tokens:
        return spark.createDataFrame([], "term int, token string")
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(vocab_json(tokens)), "array<string>")).alias("term", "token"))
    return rows.select(F.col("term").cast("int"), "token")


def vocab_sha256(tokens: list[str] | DataFrame) -> str:
    """The hash of the tokens in order, a line each; of a table the driver gets lines of many tokens, part by part."""
    if not isinstance(tokens, DataFrame):
        return hashlib.sha256("\n".join(tokens).encode()).hexdigest()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(["\n".join(b.column(0).to_pylist())])], ["lines"])

    h, first = hashlib.sha256(), True
    for r in tokens.orderBy("term").select("token").mapInArrow(joined, "lines string").toLocalIterator():
        h.update(("" if first else "\n").encode() + r["lines"].encode())
        first = False
    return h.hexdigest()


def check_table(vocab: DataFrame) -> int:
    """As check_tokens for a table (term, token), whose terms must be 0, 1, 2 ...; returns how many there are."""
    bad = F.col("token").isNull() | (F.octet_length("token") == 0) | (F.octet_length("token") > MAX_TOKEN_BYTES)
    n, top, low, wrong = vocab.agg(F.count("*"), F.max("term"), F.min("term"), F.count(F.when(bad, 1))).first()
    if not n:
        raise ValueError("the vocabulary is empty")
    if wrong or low != 0 or top != n - 1:
        raise ValueError("a vocabulary token is empty or too long, or terms are not numbered from 0")
    for c in ("token", "term"):
        twice = vocab.groupBy(c).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"vocabulary {c} {twice[0][0]} is duplicate")
    return n


#: Tokens that begin alike in so many characters are numbered in one task.
PREFIX = 3


def build_vocab(words: DataFrame, min_documents: int = 3) -> DataFrame:
    """(term, token, df) from words(token), a row for each document that holds a token: tokens of min_documents rows or
    more, by code point.

    Tokens are numbered by their first characters: how many come before a beginning, and the place among those that
    share it. Only beginnings meet in one task.
    """
    return number_tokens(document_counts(words, min_documents))


def document_counts(words: DataFrame, min_documents: int = 3) -> DataFrame:
    """(token, df) of words(token), as in build_vocab."""
    return words.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_documents)


def number_tokens(df: DataFrame) -> DataFrame:
    """(term, token, df) of (token, df), which is read twice; where it is costly, it is best written before."""
    df = df.withColumn("_start", F.substring("token", 1, PREFIX))
    before = W.orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    starts = df.groupBy("_start").agg(F.count("*").alias("_n")).select("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(W.partitionBy("_start").orderBy("token"))
    return df.join(starts, "_start").select((F.col("_off") + place - 1).cast("int").alias("term"), "token", "df")
