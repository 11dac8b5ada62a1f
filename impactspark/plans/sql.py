"""The SQL surface: table functions over an index, and scalar functions.

    SELECT * FROM sparse_match('river stone', 5)
    SELECT q.id, m.* FROM q, LATERAL sparse_match(q.text, 5) m
    SELECT * FROM sparse_match_terms('{"river": 2.0}', 5)
    SELECT sparse_tokens('maples'), sparse_version()

A correlated call is decorrelated by Catalyst into one join of all queries with the postings. Postings are joined by
their partition too, so that those of other terms are not read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import impactspark
from impactspark.functions.impacts import divisor
from impactspark.functions.tokenizer import MAX_QUERY_TERMS, WordPiece
from impactspark.functions.tokenizer import sparse_tokens as tokens_column
from impactspark.operators.blocks import BLOCK
from impactspark.operators.index import EXTERNAL, MAX_BROADCAST_TERMS, SparseIndex
from impactspark.operators.retrieval import DEFAULT_K
from impactspark.session import ship
from impactspark.sources.layout import BUCKETS

_RANKED = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(q STRING, k INT DEFAULT {k}) RETURNS TABLE(rowid BIGINT, score DOUBLE)
RETURN SELECT rowid, score FROM (
  SELECT rowid, score, row_number() OVER (ORDER BY score DESC, rowid) AS rk FROM (
    SELECT {hint} p.doc_id AS rowid, sum(v.qw * p.w) / {divisor}D AS score
    FROM (SELECT term, qw, pmod(term, {buckets}) AS tb FROM ({vector}) WHERE qw <> 0) v JOIN {postings} p ON p.tb = v.tb AND p.term = v.term
    GROUP BY p.doc_id) WHERE score > 0)
WHERE rk <= if(k > 0, k, {k})
"""

# For many queries. Postings are parted by spans of documents first, so sums need no shuffle of (query, document) rows, and
# each span hands on its k best: Catalyst puts the text of a query into the window, which then has no limit of its own.
_RANKED_MANY = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(q STRING, k INT DEFAULT {k}) RETURNS TABLE(rowid BIGINT, score DOUBLE)
RETURN SELECT rowid, score FROM (
  SELECT b.rowid, -b.s AS score, row_number() OVER (ORDER BY b.s, b.rowid) AS rk FROM (
    SELECT explode(best) AS b FROM (SELECT slice(best, 1, if(k > 0, k, {k})) AS best FROM (
      SELECT array_sort(collect_list(struct(s, rowid))) AS best FROM (
        SELECT {hint} p.span, p.doc_id AS rowid, -(sum(v.qw * p.w) / {divisor}D) AS s
        FROM (SELECT term, qw, pmod(term, {buckets}) AS tb FROM ({vector}) WHERE qw <> 0) v JOIN {postings} p ON p.tb = v.tb AND p.term = v.term
        GROUP BY p.span, p.doc_id) WHERE s < 0
      GROUP BY span))))
WHERE rk <= if(k > 0, k, {k})
"""


def register_functions(spark: SparkSession, index: SparseIndex, prefix: str = "sparse", max_queries: int = 1) -> dict[str, str]:
    """Install <prefix>_match, _match_terms, _tokens and _version for an index, as temporary functions and views.

    max_queries: how many rows a LATERAL call joins at most. Their terms are broadcast if that proves them few enough;
    beyond, Spark joins them by shuffle. For more than one, the postings are shuffled once by document. They hold the state of the index at this moment; register again after changes. Returns names by purpose.
    """
    tag = uuid.uuid4().hex[:8]
    names = {n: f"{prefix}_{n}_{tag}" for n in ("postings", "weights", "vocab")}
    live = index._in_range(index.postings).select("tb", "term", "doc_id", "w")
    if index.manifest.tombstones:
        live = live.join(index.tombstones.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
    if max_queries > 1:
        cores, n = spark.sparkContext.defaultParallelism, int(index.meta["ndocs"])
        span = max(1, min(BLOCK, n // (4 * cores)))
        live = live.withColumn("span", F.floor(F.col("doc_id") / span)).repartition(max(cores, n // span), "span")
    live.createOrReplaceTempView(names["postings"])
    ranked = _RANKED_MANY if max_queries > 1 else _RANKED
    index.small(index.qlut.join(index.vocab, "term")).createOrReplaceTempView(names["weights"])
    index.small(index.vocab).createOrReplaceTempView(names["vocab"])
    hint = "/*+ BROADCAST(v) */" if max_queries * MAX_QUERY_TERMS <= MAX_BROADCAST_TERMS else ""
    fill = {"k": DEFAULT_K, "divisor": divisor(index.mode, index.scale), "postings": names["postings"], "hint": hint, "buckets": BUCKETS}
    if index.meta["model_id"] != EXTERNAL:
        if index.meta["analyzer"] == "ascii":
            words = f"slice(regexp_extract_all(lower(q), '([a-z]+)', 1), 1, {MAX_QUERY_TERMS})"
        else:
            ship(spark)
            words = f"{prefix}_words_{tag}(q)"
            spark.udf.register(f"{prefix}_words_{tag}", _words_udf(index.tokens))
        vector = f"SELECT x.term, sum(x.qw) AS qw FROM {names['weights']} x JOIN (SELECT explode({words}) AS t) e ON e.t = x.token GROUP BY x.term"
        spark.sql(ranked.format(name=f"{prefix}_match", vector=vector, **fill))
    given = "SELECT explode(from_json(q, 'map<string,variant>')) AS (token, v)"
    number = "CASE WHEN upper(schema_of_variant(v)) RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$' THEN try_variant_get(v, '$', 'double') ELSE CAST(raise_error('a weight must be a number') AS DOUBLE) END"
    vector = f"SELECT term, sum(wt) AS qw FROM (SELECT x.term, {number} AS wt FROM ({given}) e JOIN {names['vocab']} x ON x.token = e.token) WHERE wt > 0 GROUP BY term"
    spark.sql(ranked.format(name=f"{prefix}_match_terms", vector=vector, **fill))
    spark.udf.register(f"{prefix}_tokens", _tokens_udf(index.tokens))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_version() RETURNS STRING RETURN '{version()}'")
    return names | {"match": f"{prefix}_match", "match_terms": f"{prefix}_match_terms", "tokens": f"{prefix}_tokens", "version": f"{prefix}_version"}


def version() -> str:
    return f"impactspark {impactspark.__version__}"


def _words_udf(tokens: list[str]):
    held: list[WordPiece] = []

    def words(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(WordPiece(tokens))
        out = [None if t is None else [tokens[i] for i in held[0].encode(t, MAX_QUERY_TERMS)] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.string()))

    words.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(words, "array<string>")


def _tokens_udf(tokens: list[str]):
    import json

    held: list[WordPiece] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(WordPiece(tokens))
        return pa.array([None if t is None else json.dumps([tokens[i] for i in held[0].encode(t)], ensure_ascii=False, separators=(",", ":")) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


__all__ = ["register_functions", "tokens_column", "version"]
