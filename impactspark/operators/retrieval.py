"""Ranking: exact dot products, ties by lower id, top k per query, and what may be joined to the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_K = 10


def effective_k(k: int | None = None, limit: int | None = None, offset: int = 0) -> int:
    """k if positive, else the limit (with its offset), else the default."""
    if k is not None and k > 0:
        return k
    if limit is not None and limit > 0:
        return limit + offset
    return DEFAULT_K


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The k best by (score desc, rowid asc), for each key if there are any, with their rank.

    Without keys this is TakeOrderedAndProject: k rows a task. With keys, the rank filter lets Spark keep k rows of
    each key in each task before anything is shuffled (WindowGroupLimit).
    """
    order = (F.desc("score"), F.asc("rowid"))
    if not keys:
        best = scored.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def explain_scores(postings: DataFrame, terms: DataFrame, vocab: DataFrame, scale: float) -> DataFrame:
    """(qid, rowid, token, qw, w, part): what every query term adds to a document's score."""
    hit = postings.join(terms, [c for c in ("tb", "term") if c in terms.columns]).join(vocab, "term")
    return hit.select("qid", F.col("doc_id").alias("rowid"), "token", "qw", "w", (F.col("qw") * F.col("w") / F.lit(scale)).alias("part"))


#: Ids that one row of packed postings spans.
PACK = 1 << 16


def packed_postings(postings: DataFrame) -> DataFrame:
    """(term, block, docs array, ws array): parallel arrays by ascending document, a row for each PACK ids of a term, so
    that the row of a term which all documents hold stays small."""
    pairs = F.array_sort(F.collect_list(F.struct("doc_id", "w")))
    packed = postings.groupBy("term", F.floor(F.col("doc_id") / PACK).alias("block")).agg(pairs.alias("p"))
    return packed.select("term", "block", F.col("p.doc_id").alias("docs"), F.col("p.w").alias("ws"))


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of the rows of each key the one with the highest sequence, as an upsert log leaves it.

    max_by keeps one row a key in every task, so a key of any number of versions is combined before the shuffle.
    """
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(packed, F.col(seq)).alias("_r")).select("_r.*")


def max_pool(states: DataFrame, keys: list[str], column: str = "h") -> DataFrame:
    """(keys, term, w): the greatest value at each place of the vectors of a key, through log1p of its positive part."""
    flat = states.select(*keys, F.posexplode(column).alias("term", "v"))
    peak = flat.groupBy(*keys, "term").agg(F.max(F.col("v").cast("double")).alias("v"))
    return peak.select(*keys, "term", F.log1p(F.greatest(F.col("v"), F.lit(0.0))).alias("w"))


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg) of ranked(qid, rowid, rank) against judged(qid, rowid, gain); queries without gains are left out."""
    log2 = F.log2(F.col("rank") + 1)
    got = ranked.where(F.col("rank") <= k).join(judged, ["qid", "rowid"]).groupBy("qid").agg(F.sum(F.col("gain") / log2).alias("dcg"))
    place = W.partitionBy("qid").orderBy(F.desc("gain"), F.asc("rowid"))
    ideal = judged.where("gain > 0").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    ideal = ideal.groupBy("qid").agg(F.sum(F.col("gain") / log2).alias("idcg"))
    return ideal.join(got, "qid", "left").select("qid", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(qid, shared): the share of a's first k that b has among its first k."""
    x, y = (t.where(F.col("rank") <= k).select("qid", "rowid") for t in (a, b))
    n = x.groupBy("qid").agg(F.count("*").alias("n"))
    both = x.join(y, ["qid", "rowid"]).groupBy("qid").agg(F.count("*").alias("both"))
    return n.join(both, "qid", "left").select("qid", (F.coalesce("both", F.lit(0)) / F.col("n")).alias("shared"))
