"""python -m impactspark build|search|sync|attach|info|convert|tokens|head"""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from impactspark.functions.encoders import MAX_SEQ, LexicalEncoder, head_weights
from impactspark.functions.models import register_model
from impactspark.functions.tokenizer import ascii_words
from impactspark.operators.index import SparseIndex
from impactspark.session import get_spark
from impactspark.sources.jsonl import read_jsonl
from impactspark.sources.sidecar import extract_sidecar, read_sidecar
from impactspark.sources.vocabulary import build_vocab
from impactspark.streaming.sync import attach

LEXICAL = "lexical"


def lexical_weights(docs, min_documents: int = 3):
    """(vocabulary with query weights, number of documents): inverse document frequencies cut to 1/1024."""
    words = docs.select(F.explode(F.array_distinct(ascii_words(F.coalesce("text", F.lit(""))))).alias("token"))
    return weigh(build_vocab(words, min_documents), docs.count())


def weigh(vocab, n: int):
    """A vocabulary with document frequencies, and the query weights that they give among n documents."""
    return vocab.withColumn("qw", F.floor(F.log(F.lit(float(n)) / F.col("df")) * 1024) / 1024)


def _register(index: SparseIndex) -> None:
    """The model of an index, as the index holds it: whoever opens it encodes as its builder did."""
    if index.meta["model_id"] == LEXICAL:
        register_model(LEXICAL, LexicalEncoder(index.vocab, index.qlut, LEXICAL, max_seq=int(index.meta["max_seq"])))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="impactspark")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("build", help="index JSON lines of {id, text[, title]}")
    c.add_argument("index")
    c.add_argument("jsonl")
    c.add_argument("--min-documents", type=int, default=1, help="a word is in the vocabulary from this many documents on")
    c = sub.add_parser("search", help="rank documents for a text")
    c.add_argument("index")
    c.add_argument("query")
    c.add_argument("-k", default=10, type=int, help="how many")
    c.add_argument("--terms", action="store_true", help="the query is a JSON object of token weights")
    c = sub.add_parser("sync", help="write what is queued")
    c.add_argument("index")
    c = sub.add_parser("attach", help="queue and write the rows of a Parquet table")
    c.add_argument("index")
    c.add_argument("table")
    c.add_argument("columns", help="comma-separated")
    c.add_argument("--id-col", required=True)
    c = sub.add_parser("info", help="print what an index holds")
    c.add_argument("index")
    c = sub.add_parser("tokens", help="print the tokens of a text")
    c.add_argument("index")
    c.add_argument("text")
    c = sub.add_parser("convert", help="make a sidecar file")
    c.add_argument("model")
    c.add_argument("out", help="path of the sidecar")
    c.add_argument("--double-log", help="the model takes the logarithm twice", action="store_true")
    c = sub.add_parser("head", help="print the weights that a sidecar's head gives to hidden states")
    c.add_argument("sidecar")
    c.add_argument("states", help="a .npy file of an array (tokens, hidden)")
    c.add_argument("-k", default=20, type=int, help="how many terms, the heaviest first")
    a = p.parse_args(argv)

    if a.command == "convert":
        extract_sidecar(a.model, a.out, int(a.double_log))
        return 0
    if a.command == "head":
        sidecar = read_sidecar(a.sidecar)
        terms, w = head_weights(np.load(a.states), sidecar)
        for i in np.lexsort((terms, -w))[: a.k]:
            print("%8.4f  %s" % (w[i], sidecar.tokens[terms[i]]))
        return 0
    # a session that is there already keeps its settings
    spark = SparkSession.getActiveSession() or get_spark()
    if a.command == "build":
        docs = read_jsonl(spark, a.jsonl)
        vocab = lexical_weights(docs.withColumnRenamed("ext_id", "doc_id"), a.min_documents)
        # counted once: tokens and weights are both written from the same table
        vocab = vocab.persist()
        index = SparseIndex.create_from(spark, a.index, vocab.select("term", "token"), vocab.select("term", "qw"), LEXICAL, analyzer="ascii", max_seq=MAX_SEQ)
        vocab.unpersist()
        _register(index)
        print(f"indexed {index.insert_text(docs)} docs -> {a.index}")
        return 0
    index = SparseIndex(spark, a.index)
    _register(index)
    if a.command == "search":
        hits = index.search_terms(a.query, a.k) if a.terms else index.search(a.query, a.k)
        for r in hits.collect():
            print("%8.3f  %s  %.70s" % (r["score"], r["ext_id"], r["title"] or ""))
    elif a.command == "sync":
        print(f"synced {index.sync()} docs")
    elif a.command == "attach":
        attach(index, spark.read.parquet(a.table), a.columns.split(","), a.id_col)
        print(f"attached {a.table}({a.columns}); synced {index.sync()} rows")
    elif a.command == "tokens":
        from impactspark.operators.index import query_pieces

        print(json.dumps(query_pieces(index.tokens, a.text), ensure_ascii=False))
    elif a.command == "info":
        print(json.dumps(index.info(), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
