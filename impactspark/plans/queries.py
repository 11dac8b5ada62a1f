"""The registered queries over the driver's tables, with the same results in DuckDB SQL.

A corpus index is built once per session and folder: words of a-z, a vocabulary of those in three documents or more,
weights of half their frequency, query weights cut to multiples of 1/1024. Such sums are exact in any order, so
scores agree to the bit. Ids of the index are doc_id + 1.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.cli import lexical_weights, weigh
from impactspark.functions.encoders import LexicalEncoder, document_words, lexical_terms
from impactspark.functions.impacts import quantize
from impactspark.functions.models import register_model
from impactspark.functions.tokenizer import ascii_words, sparse_tokens, token_ids
from impactspark.operators import retrieval as R
from impactspark.operators.index import SparseIndex, weight_differences
from impactspark.plans import surface
from impactspark.plans.sql import register_functions
from impactspark.session import scratch_dir, shared_file, ship
from impactspark.sources import sqlite_file
from impactspark.sources.vocabulary import document_counts, number_tokens, vocab_sha256
from impactspark.streaming.sync import apply_changes, backfill, ingest

_BUILT: dict[tuple, SparseIndex] = {}
_LEXICA: dict[tuple, tuple[DataFrame, DataFrame]] = {}
SEQ = 64
#: Changes of one kind have numbers below this, so that those of the next kind come after them.
PHASE = 1 << 40


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select((F.col("doc_id") + 1).alias("id"), F.col("doc_id").cast("string").alias("ext_id"), F.col("source").alias("title"), "text")


def _new_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"


def lexicon(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The words of each document, and from them (term, token, qw): tables, so that the texts are read once."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LEXICA:
        path = _new_path(spark)

        def kept(df: DataFrame, kind: str) -> DataFrame:
            df.write.parquet(f"{path}-{kind}")
            return spark.read.schema(df.schema).parquet(f"{path}-{kind}")

        words = kept(document_words(_rows(spark, d)), "words")
        counts = kept(document_counts(words.select(F.explode("token").alias("token"))), "df")
        _LEXICA[key] = words, kept(weigh(number_tokens(counts), words.count()).select("term", "token", "qw"), "lexicon")
    return _LEXICA[key]


def empty(spark: SparkSession, d: str, mode: str = "u8") -> SparseIndex:
    """An index for documents, before any is written: their vocabulary, its query weights, and its model."""
    _, tokens = lexicon(spark, d)
    name = f"lexical-{zlib.crc32(d.encode()):08x}"
    ix = SparseIndex.create_from(spark, _new_path(spark), tokens.select("term", "token"), tokens.select("term", "qw"), name, weight_mode=mode, analyzer="ascii")
    register_model(name, LexicalEncoder(ix.vocab, ix.qlut, name))
    return ix


def corpus(spark: SparkSession, d: str, mode: str = "u8", variant: str = "") -> SparseIndex:
    """The index of documents; with a variant name, a clone of its own that may be changed."""
    key = (spark.sparkContext.applicationId, d, mode, variant)
    if key not in _BUILT:
        if variant:
            _BUILT[key] = corpus(spark, d, mode).clone(_new_path(spark))
            return _BUILT[key]
        ix = empty(spark, d, mode)
        ix.build_bulk(_rows(spark, d), words=lexicon(spark, d)[0])
        _BUILT[key] = ix
    return _BUILT[key]


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    ix = corpus(spark, d)
    return ix.small(ix.vocab)


def _blocks(ix: SparseIndex) -> SparseIndex:
    """The index with its blocks of documents, which batches of queries need and nothing else does."""
    if not ix.manifest.blocks or ix.manifest.blocked != ix.manifest.postings:
        ix.optimize()
    return ix


def _without_toxic(spark: SparkSession, d: str) -> SparseIndex:
    """The corpus with the documents labelled toxic deleted."""
    ix = corpus(spark, d, variant="toxic")
    if not ix.manifest.tombstones:
        ix.delete(where=_read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("ext_id")))
    return ix


def _item(spark: SparkSession, d: str, n: int) -> str:
    return _read(spark, d, "benchmark").where(F.col("item_id") == n).first()["text"]


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select((F.col("rowid") - 1).alias("doc_id"), "score", "rank")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _batch(hits: DataFrame) -> DataFrame:
    return hits.select("qid", (F.col("rowid") - 1).alias("doc_id"), "score", "rank")


# ---- vocabulary, encoding


def vocab_build(spark, d):
    return lexical_weights(_read(spark, d, "documents")).select("term", "token", "df")


def qlut_nonzero(spark, d):
    ix = corpus(spark, d)
    return ix.qlut.join(F.broadcast(ix.vocab), "term").select("term", "token", "qw")


def tokens_per_doc(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.size(ascii_words(F.col("text"))).cast("long").alias("n_tokens"))


def truncation_report(spark, d):
    got = lexical_terms(_rows(spark, d), _vocab(spark, d), SEQ)
    per = got.groupBy("id").agg(F.max("ntokens").cast("long").alias("ntokens"), F.max("truncated").alias("truncated"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"))
    return per.select((F.col("id") - 1).alias("doc_id"), "ntokens", "truncated", "weight")


def encode_documents(spark, d):
    got = lexical_terms(_rows(spark, d), _vocab(spark, d)).where("term is not null")
    return got.select((F.col("id") - 1).alias("doc_id"), "term", "w")


def quantize_u8(spark, d):
    got = lexical_terms(_rows(spark, d), _vocab(spark, d)).where("term is not null")
    # weights off the grid as well, where rounding to even in single precision shows
    return got.select((F.col("id") - 1).alias("doc_id"), "term", quantize(F.col("w") * 0.725).cast("int").alias("wq"))


def postings_f32(spark, d):
    ix = corpus(spark, d, "f32")
    return ix.postings.select("term", (F.col("doc_id") - 1).alias("doc_id"), F.col("w").cast("double").alias("w"))


def postings_packed(spark, d):
    got = R.packed_postings(corpus(spark, d).postings)
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return got.select("term", "block", F.md5(text("docs")).alias("docs"), F.md5(text("ws")).alias("ws"), F.size("docs").cast("long").alias("n"))


def posting_fetch(spark, d):
    ix = corpus(spark, d)
    return ix.posting([3, 5, 8, 13]).select("term", (F.col("doc_id") - 1).alias("doc_id"), F.col("w").cast("int").alias("wq"))


def meta_table(spark, d):
    ix = corpus(spark, d)
    keep = ("weight_mode", "weight_scale", "ndocs", "vocab_sha256")
    return spark.createDataFrame([(k, ix.meta[k]) for k in keep], "k string, v string")


def vocab_hash(spark, d):
    rows = lexical_weights(_read(spark, d, "documents"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("term", "token"))), lambda x: x["token"])
    return rows.agg(F.sha2(F.concat_ws("\n", every), 256).alias("vocab_sha256"))


def model_compat_diff(spark, d):
    """The index's query weights against those of a model with a few of them changed."""
    ix = corpus(spark, d)
    other = ix.qlut.select("term", F.when(F.col("term") % 97 == 0, F.col("qw") + 0.5).otherwise(F.col("qw")).alias("qw")).where("term % 101 <> 0")
    return weight_differences(ix.qlut, other).select("term", "a", "b")


# ---- matching


def match_text_topk(spark, d):
    return _hits(corpus(spark, d).match(_item(spark, d, 3), k=10))


def match_text_default_k(spark, d):
    return _hits(corpus(spark, d).match(_item(spark, d, 11)))


def match_limit_vs_k(spark, d):
    """k alone, the limit alone, and both: k is the number of candidates, the limit cuts what is shown."""
    ix, text = corpus(spark, d), _item(spark, d, 4)
    cases = {"k": {"k": 5}, "limit": {"limit": 7}, "both": {"k": 12, "limit": 4}, "page": {"limit": 3, "offset": 3}}
    parts = [_hits(ix.match(text, **c)).withColumn("kind", F.lit(n)) for n, c in cases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


VECTOR = '{"the": 2.0, "and": 1.25, "the": 0.5, "zzzqqq": 9.0, "of": -1.0, "in": 0.0, "de": 1.5}'


def match_terms_topk(spark, d):
    return _hits(corpus(spark, d).match_terms(VECTOR, k=15))


def match_batch_topk(spark, d):
    return _batch(_blocks(corpus(spark, d)).match_batch(_queries(spark, d), k=10))


def match_terms_batch(spark, d):
    one = F.concat(F.lit('{"the": 1.5, "ing": '), (F.col("qid") + 1).cast("string"), F.lit(', "de": 2, "la": 0.25}'))
    return _batch(_blocks(corpus(spark, d)).match_terms_batch(_queries(spark, d).select("qid", one.alias("terms")), k=5))


def match_lateral_sql(spark, d):
    ix, items = corpus(spark, d), _queries(spark, d)
    register_functions(spark, ix, max_queries=items.count())
    items.createOrReplaceTempView("sparse_queries")
    return spark.sql("SELECT q.qid, m.rowid - 1 AS doc_id, m.score FROM sparse_queries q, LATERAL sparse_match(q.text, 5) m")


def match_terms_sql(spark, d):
    register_functions(spark, corpus(spark, d))
    return spark.sql(f"SELECT rowid - 1 AS doc_id, score FROM sparse_match_terms('{VECTOR}', 8)")


def match_then_join_filter(spark, d):
    hits = _hits(corpus(spark, d).match(_item(spark, d, 3), k=50))
    docs = _read(spark, d, "documents").select("doc_id", "lang", "source")
    return F.broadcast(hits).join(docs, "doc_id").where("lang = 'en'").orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score", "source")


def match_rowid_residual(spark, d):
    """An id beside a match is a filter on the candidates, not a lookup."""
    hits = _hits(corpus(spark, d).match(_item(spark, d, 3), k=50))
    return hits.where("doc_id % 7 = 0")


def search_hydrated(spark, d):
    got = corpus(spark, d).search(_item(spark, d, 9), k=10)
    return got.select(F.col("id").alias("id"), "ext_id", "title", "score")


def score_explain(spark, d):
    got = corpus(spark, d).explain_match(_item(spark, d, 3))
    return got.select((F.col("rowid") - 1).alias("doc_id"), "token", "qw", F.col("w").cast("int").alias("wq"), "part")


def query_weights(spark, d):
    ix = corpus(spark, d)
    return ix.encode_queries(_queries(spark, d)).select("qid", "term", "qw")


# ---- live state


def scan_live(spark, d):
    return _without_toxic(spark, d).scan().select((F.col("rowid") - 1).alias("doc_id"), "score")


def lookup_rowid(spark, d):
    return _without_toxic(spark, d).lookup(18).select((F.col("rowid") - 1).alias("doc_id"), "score")


def count_live(spark, d):
    return _without_toxic(spark, d).count()


def deleted_ids(spark, d):
    return _without_toxic(spark, d).deleted_ids().select((F.col("id") - 1).alias("doc_id"))


def soft_delete_topk(spark, d):
    return _batch(_blocks(_without_toxic(spark, d)).match_batch(_queries(spark, d), k=10))


def compact_removed(spark, d):
    ix = corpus(spark, d, variant=f"compact-{uuid.uuid4().hex}")
    ix.delete(where=_read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("ext_id")))
    before = ix.postings.count()
    removed, again = ix.compact(), ix.compact()
    return spark.createDataFrame([(before, removed, again, ix.postings.count())], "before long, removed long, again long, after long")


def upsert_latest(spark, d):
    """Turns of a conversation are versions of one document; the last one stays."""
    ix = corpus(spark, d, variant=f"upsert-{uuid.uuid4().hex}")
    base = int(ix.meta["ndocs"])
    turns = _read(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id")).alias("ext_id"), F.col("role").alias("title"), "text", F.col("turn").alias("seq"))
    ix._insert(turns.withColumn("id", F.lit(None).cast("long")), ix._encode_text(), body="text")
    return ix.live.where(F.col("id") > base).select("ext_id", F.col("title").alias("role"), F.col("body").alias("text"))


def attach_backfill(spark, d):
    return backfill(_read(spark, d, "part"), ["p_name", "p_brand", "p_type"], "p_partkey").select("ext_id", "body")


def change_feed(spark, d):
    """Inserts, updates, renames and deletions of parts, applied in order, whatever the greatest key is.

    Renames go from the highest key down: an id that another part takes was given up before.
    """
    ix = corpus(spark, d, variant=f"feed-{uuid.uuid4().hex}")
    ix.delete(where=ix.live.select("id"))
    part = _read(spark, d, "part")
    k = F.col("p_partkey")
    row = lambda op, seq, new, old=None: part.select(F.lit(op).alias("op"), (seq).alias("seq"), new.alias("id"), (old if old is not None else F.lit(None).cast("long")).alias("old_id"), "p_name", "p_type")
    feed = row("insert", k, k).unionByName(row("delete", k + PHASE, k).where(k % 3 == 0)).unionByName(row("update", 3 * PHASE - k, k + 500_000, k).where(k % 5 == 0))
    apply_changes(ix, feed, ["p_name", "p_type"])
    return ix.live.select("ext_id")


def pending_queue(spark, d):
    """What is queued is not found before sync, and found after it."""
    ix = corpus(spark, d, variant=f"queue-{uuid.uuid4().hex}")
    ix.queue(_read(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("ext_id"), F.lit("").alias("title"), F.col("text").alias("body"), F.col("item_id").alias("seq")))
    waiting = ix.pending_count()
    before = ix.live.where("ext_id like 'b%'").count()
    synced = ix.sync()
    return spark.createDataFrame([(waiting, before, synced, ix.pending_count(), ix.live.where("ext_id like 'b%'").count())], "waiting long, before long, synced long, left_over long, after long")


def stream_sync_topk(spark, d):
    """Documents arrive as a stream of files; the index that results ranks as the one built at once."""
    base = corpus(spark, d)
    name = base.meta["model_id"]
    ix = SparseIndex.create_from(spark, _new_path(spark), base.vocab, base.qlut, name, analyzer="ascii")
    feed = f"{_new_path(spark)}-feed"
    _rows(spark, d).write.parquet(feed)
    rows = spark.readStream.schema("id long, ext_id string, title string, text string").parquet(feed)
    query = ingest(ix, rows, f"{_new_path(spark)}-checkpoint")
    query.awaitTermination()
    ix.reload()
    return _batch(_blocks(ix).match_batch(_queries(spark, d), k=10))


def jsonl_source(spark, d):
    from impactspark.sources.jsonl import read_jsonl

    path = f"{_new_path(spark)}-jsonl"
    _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title")).write.json(path)
    return read_jsonl(spark, path).select("ext_id", "title", F.md5("text").alias("text_md5"))


# ---- tokenizer


def wordpiece_tokens(spark, d):
    """WordPiece over a vocabulary of single letters and their continuations: every word falls into its letters."""
    ship(spark)
    letters = [chr(c) for c in range(97, 123)]
    tokens = ["[UNK]", *letters, *(f"##{c}" for c in letters)]
    words = _read(spark, d, "benchmark").select("item_id", F.array_join(ascii_words(F.col("text")), " ").alias("text"))
    return words.select("item_id", F.array_join(token_ids(F.col("text"), tokens, 512).cast("array<string>"), ",").alias("ids"))


def sparse_tokens_json(spark, d):
    ship(spark)
    ix = corpus(spark, d)
    words = _read(spark, d, "benchmark").select("item_id", F.array_join(ascii_words(F.col("text")), " ").alias("text"))
    return words.select("item_id", sparse_tokens(F.col("text"), ix.tokens).alias("tokens"))


# ---- head, quality, files


def head_maxpool(spark, d):
    got = R.max_pool(_read(spark, d, "embeddings"), ["label"], "embedding")
    return got.select("label", "term", F.round("w", 6).alias("w"))


def u8_vs_f32_overlap(spark, d):
    q = _queries(spark, d)
    got = R.overlap(_blocks(corpus(spark, d)).match_batch(q, k=10), _blocks(corpus(spark, d, "f32")).match_batch(q, k=10))
    return got.select("qid", F.round("shared", 6).alias("shared"))


def ndcg_at_10(spark, d):
    """A document is relevant to an item if its language is that of the best document that holds the item's words."""
    hits = _blocks(corpus(spark, d)).match_batch(_queries(spark, d), k=10)
    docs = _read(spark, d, "documents").select((F.col("doc_id") + 1).alias("rowid"), "n_chars")
    gains = hits.join(docs, "rowid").select("qid", "rowid", (F.col("n_chars") % 4).cast("double").alias("gain"))
    return R.ndcg(hits, gains, 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


def sqlite_roundtrip(spark, d):
    """Out to a single file and back, then the same ranking."""
    file = shared_file(spark, f"{uuid.uuid4().hex}.db")
    corpus(spark, d).export_sqlite(file)
    back = SparseIndex.import_sqlite(spark, file, _new_path(spark), analyzer="ascii")
    return _hits(back.match(_item(spark, d, 3), k=10))


def sqlite_source(spark, d):
    """Postings of a few terms straight from a single file, the terms pushed down to it."""
    ship(spark)
    file = shared_file(spark, f"{uuid.uuid4().hex}.db")
    corpus(spark, d).export_sqlite(file)
    got = sqlite_file.read_table(spark, file, "postings").where(F.col("term").isin(3, 5, 8, 13))
    return got.select("term", (F.col("doc_id") - 1).alias("doc_id"), F.round(F.col("w") * 40).cast("int").alias("wq"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vocab_build, qlut_nonzero, tokens_per_doc, truncation_report, encode_documents, quantize_u8, postings_f32, postings_packed, posting_fetch, meta_table, vocab_hash,
        model_compat_diff, match_text_topk, match_text_default_k, match_limit_vs_k, match_terms_topk, match_batch_topk, match_terms_batch, match_lateral_sql, match_terms_sql,
        match_then_join_filter, match_rowid_residual, search_hydrated, score_explain, query_weights, scan_live, lookup_rowid, count_live, deleted_ids, soft_delete_topk,
        compact_removed, upsert_latest, attach_backfill, change_feed, pending_queue, stream_sync_topk, jsonl_source, wordpiece_tokens, sparse_tokens_json, head_maxpool,
        u8_vs_f32_overlap, ndcg_at_10, sqlite_roundtrip, sqlite_source,
    )
}

_BASE = """with tok as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)', 1)) as token from documents),
tf as (select doc_id, token, count(*) as tf from tok group by all),
vb as (select token, count(*) as df from tf group by token having count(*) >= 3),
vocab as (select (row_number() over (order by token) - 1)::int as term, token, df from vb),
qlut as (select * from (select term, floor(ln((select count(*) from documents)::double / df::double) * 1024) / 1024 as qw from vocab) where qw <> 0),
post as (select term, doc_id, greatest(1, least(255, round_even((tf * 0.5)::float * 40::float, 0)))::int as wq, tf * 0.5::double as w from tf join vocab using (token)),
qtok as (select item_id as qid, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) as token from benchmark),
qv as (select qid, term, sum(qw) as qw from qtok join vocab using (token) join qlut using (term) group by all),
gone as (select distinct doc_id from labels join documents using (doc_id) where toxic = 1),
sc as (select qid, doc_id, sum(qw * wq) / 40.0::double as score from qv join post using (term) group by all having sum(qw * wq) > 0),
rk as (select *, (row_number() over (partition by qid order by score desc, doc_id))::int as rank from sc)
"""
_VEC = """, given(token, wt) as (values ('the', 2.0::double), ('and', 1.25), ('the', 0.5), ('zzzqqq', 9.0), ('of', -1.0), ('in', 0.0), ('de', 1.5)),
gv as (select term, sum(wt) as qw from given join vocab using (token) where wt > 0 group by term),
gs as (select doc_id, sum(qw * wq) / 40.0::double as score from gv join post using (term) group by doc_id),
gr as (select *, (row_number() over (order by score desc, doc_id))::int as rank from gs)
"""
_ONE = "select doc_id, score, rank from rk where qid = {n} and rank <= {k}"

ORACLE_SQL: dict[str, str] = {
    "vocab_build": _BASE + "select term, token, df from vocab",
    "qlut_nonzero": _BASE + "select term, token, qw from qlut join vocab using (term)",
    "tokens_per_doc": "select doc_id, len(regexp_extract_all(lower(text), '([a-z]+)', 1))::bigint as n_tokens from documents",
    "truncation_report": _BASE + f""", d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)', 1) as ws from documents),
k as (select doc_id, unnest(ws[1:{SEQ}]) as token from d), s as (select doc_id, count(*) * 0.5::double as weight from k join vocab using (token) group by doc_id)
select d.doc_id, len(ws)::bigint as ntokens, len(ws) > {SEQ} as truncated, coalesce(weight, 0.0::double) as weight from d left join s on s.doc_id = d.doc_id""",
    "encode_documents": _BASE + "select doc_id, term, w from post",
    "quantize_u8": _BASE + "select doc_id, term, greatest(1, least(255, round_even((w * 0.725::double)::float * 40::float, 0)))::int as wq from post",
    "postings_f32": _BASE + "select term, doc_id, w from post",
    "postings_packed": _BASE + "select term, (doc_id + 1) // 65536 as block, md5(string_agg((doc_id + 1)::varchar, ',' order by doc_id)) as docs, md5(string_agg(wq::varchar, ',' order by doc_id)) as ws, count(*) as n from post group by all",
    "posting_fetch": _BASE + "select term, doc_id, wq from post where term in (3, 5, 8, 13)",
    "meta_table": _BASE + """select 'weight_mode' as k, 'u8' as v union all select 'weight_scale', '40.0' union all select 'ndocs', (max(doc_id) + 1)::varchar from documents
union all select 'vocab_sha256', sha256(string_agg(token, chr(10) order by term)) from vocab""",
    "vocab_hash": _BASE + "select sha256(string_agg(token, chr(10) order by term)) as vocab_sha256 from vocab",
    "model_compat_diff": _BASE + "select term, qw as a, case when term % 101 = 0 then null else qw + 0.5 end as b from qlut where term % 97 = 0 or term % 101 = 0",
    "match_text_topk": _BASE + _ONE.format(n=3, k=10),
    "match_text_default_k": _BASE + _ONE.format(n=11, k=10),
    "match_limit_vs_k": _BASE + """select doc_id, score, rank, kind from rk join (values ('k', 0, 5), ('limit', 0, 7), ('both', 0, 4), ('page', 3, 6)) c(kind, a, b)
on rank > a and rank <= b where qid = 4""",
    "match_terms_topk": _BASE + _VEC + "select doc_id, score, rank from gr where rank <= 15",
    "match_batch_topk": _BASE + "select qid, doc_id, score, rank from rk where rank <= 10",
    "match_terms_batch": _BASE + """, g as (select item_id as qid, token, wt from benchmark, (values ('the', 1.5::double), ('de', 2.0), ('la', 0.25)) v(token, wt) union all select item_id, 'ing', item_id + 1.0::double from benchmark),
s as (select qid, doc_id, sum(wt * wq) / 40.0::double as score from g join vocab using (token) join post using (term) group by all),
r as (select *, (row_number() over (partition by qid order by score desc, doc_id))::int as rank from s)
select qid, doc_id, score, rank from r where rank <= 5""",
    "match_lateral_sql": _BASE + "select qid, doc_id, score from rk where rank <= 5",
    "match_terms_sql": _BASE + _VEC + "select doc_id, score from gr where rank <= 8",
    "match_then_join_filter": _BASE + "select doc_id, score, source from rk join documents using (doc_id) where qid = 3 and rank <= 50 and lang = 'en' order by score desc, doc_id limit 10",
    "match_rowid_residual": _BASE + "select doc_id, score, rank from rk where qid = 3 and rank <= 50 and doc_id % 7 = 0",
    "search_hydrated": _BASE + "select doc_id + 1 as id, doc_id::varchar as ext_id, source as title, score from rk join documents using (doc_id) where qid = 9 and rank <= 10",
    "score_explain": _BASE + "select doc_id, token, qw, wq, qw * wq / 40.0::double as part from qv join post using (term) join vocab using (term) where qid = 3",
    "query_weights": _BASE + "select qid, term, qw from qv",
    "scan_live": _BASE + "select doc_id, 0.0::double as score from documents where doc_id not in (select doc_id from gone)",
    "lookup_rowid": _BASE + "select doc_id, 0.0::double as score from documents where doc_id = 17 and doc_id not in (select doc_id from gone)",
    "count_live": _BASE + "select count(*) as n from documents where doc_id not in (select doc_id from gone)",
    "deleted_ids": _BASE + "select doc_id from gone",
    "soft_delete_topk": _BASE + """, r as (select *, (row_number() over (partition by qid order by score desc, doc_id))::int as rnk from sc where doc_id not in (select doc_id from gone))
select qid, doc_id, score, rnk as rank from r where rnk <= 10""",
    "compact_removed": _BASE + "select count(*) as before, count(*) filter (doc_id in (select doc_id from gone)) as removed, 0::bigint as again, count(*) filter (doc_id not in (select doc_id from gone)) as after from post",
    "upsert_latest": "select 'c' || conv_id as ext_id, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn = 1",
    "attach_backfill": "select p_partkey::varchar as ext_id, coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '') as body from part",
    "change_feed": """select p_partkey::varchar as ext_id from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0
union all select (p_partkey + 500000)::varchar from part where p_partkey % 5 = 0""",
    "pending_queue": "select count(*) as waiting, 0::bigint as before, count(*) as synced, 0::bigint as left_over, count(*) as after from benchmark",
    "stream_sync_topk": _BASE + "select qid, doc_id, score, rank from rk where rank <= 10",
    "jsonl_source": "select doc_id::varchar as ext_id, case when doc_id % 2 = 0 then source else '' end as title, md5(text) as text_md5 from documents",
    "wordpiece_tokens": """with w as (select item_id, regexp_extract_all(lower(text), '([a-z]+)', 1) as ws from benchmark),
l as (select item_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
c as (select item_id, i, unnest(string_split(word, '')) as ch, generate_subscripts(string_split(word, ''), 1) as j from l),
n as (select item_id, case when j = 1 then ascii(ch) - 96 else ascii(ch) - 70 end as id, row_number() over (partition by item_id order by i, j) as r from c)
select w.item_id, coalesce(string_agg(id::varchar, ',' order by r), '') as ids from w left join n on n.item_id = w.item_id and r <= 512 group by w.item_id""",
    "sparse_tokens_json": _BASE + """, x as (select item_id, regexp_extract_all(lower(text), '([a-z]+)', 1) as ws from benchmark),
e as (select item_id, unnest(ws) as token, generate_subscripts(ws, 1) as i from x),
k as (select e.item_id, string_agg('"' || token || '"', ',' order by i) as j from e join vocab using (token) group by e.item_id)
select x.item_id, '[' || coalesce(j, '') || ']' as tokens from x left join k on k.item_id = x.item_id""",
    "head_maxpool": """with s as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as term from embeddings)
select label, term::int as term, round(ln(1 + greatest(max(v::double), 0)), 6) as w from s group by label, term""",
    "u8_vs_f32_overlap": _BASE + """, f as (select qid, doc_id, sum(qw * w) as score from qv join post using (term) group by all),
fr as (select *, row_number() over (partition by qid order by score desc, doc_id) as r from f)
select rk.qid, round(count(fr.doc_id) / count(*)::double, 6) as shared from rk left join fr on fr.qid = rk.qid and fr.doc_id = rk.doc_id and fr.r <= 10 where rk.rank <= 10 group by rk.qid""",
    "ndcg_at_10": _BASE + """, h as (select qid, doc_id, rank, (n_chars % 4)::double as gain from rk join documents using (doc_id) where rank <= 10),
i as (select *, row_number() over (partition by qid order by gain desc, doc_id) as p from h where gain > 0)
select qid, round((select sum(gain / log2(rank + 1)) from h where h.qid = i.qid) / sum(gain / log2(p + 1)), 6) as ndcg from i group by qid""",
    "sqlite_roundtrip": _BASE + _ONE.format(n=3, k=10),
    "sqlite_source": _BASE + "select term, doc_id, wq from post where term in (3, 5, 8, 13)",
}


QUERIES |= surface.QUERIES
ORACLE_SQL |= {name: sql.replace("{base}", _BASE).replace("{one5}", _BASE + _ONE.format(n=5, k=10)) for name, sql in surface.ORACLE_SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text against all documents, ten best each."""
    return match_batch_topk(spark, d)


__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "flagship", "vocab_sha256"]
