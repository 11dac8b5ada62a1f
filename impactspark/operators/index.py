"""SparseIndex: a learned-sparse index in a folder of Parquet tables.

Documents are weighted bags of vocabulary terms, from an encoder or from the caller; queries are tokenised, every
token has one static weight, and the score is their exact dot product. Deletion is a mark until compact().
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from impactspark.functions import models
from impactspark.functions.encoders import MAX_SEQ, Encoder, word_terms
from impactspark.functions.impacts import WEIGHT_SCALE, divisor, quantize, scores
from impactspark.functions.term_vectors import document_vectors, query_vectors
from impactspark.functions.tokenizer import MAX_QUERY_TERMS, WordPiece, ascii_words, token_ids
from impactspark.operators.blocks import BLOCK, block_postings, block_tops, blocks_schema, files_for
from impactspark.operators.retrieval import effective_k, explain_scores, top_k
from impactspark.session import ship
from impactspark.sources import sqlite_file
from impactspark.sources.layout import BUCKETS, DOCS, FORMAT, PENDING, TASK_ROWS, TOMBSTONES, VOCAB, Manifest, Store, postings_schema
from impactspark.sources.vocabulary import check_table, check_tokens, parse_vocab_json, read_vocab_file, vocab_frame, vocab_json, vocab_sha256

EXTERNAL = "external"
#: Query terms beyond this are joined by shuffle, not broadcast.
MAX_BROADCAST_TERMS = 1_000_000
#: So are vocabularies and query weights of more tokens than this.
MAX_BROADCAST_TOKENS = 4_000_000
#: Ids, with their ext_ids or what else a few bytes hold, meet longer rows by broadcast up to so many.
MAX_BROADCAST_IDS = 1_000_000
#: A batch is scored by blocks of documents up to so many query terms, which go to every task, and deleted documents.
MAX_BLOCK_TERMS, MAX_BLOCK_DELETED = 500_000, 1_000_000
WEIGHT_TOLERANCE = 1e-5


class SparseIndex:
    #: Whether the index was opened for queries alone: text cannot be written, everything else works.
    query_only = False

    def __init__(self, spark: SparkSession, path: str, model: str | None = None, vocab: str | None = None, query_only: bool = False, **options):
        """Open the index at path; where there is none, create it from a registered model or from a vocabulary file.

        query_only: no model is asked for; matching, term vectors, deletion and compaction work, writing text is refused.
        """
        self.spark, self.store, self.query_only = spark, Store(spark, path), query_only
        if model and vocab:
            raise ValueError("give model='name' or vocab='file', not both")
        if self.store.exists():
            if vocab:
                raise ValueError("vocab= only applies when creating an index")
            self.reload()
            if model and self.manifest.meta["model_id"] != model:
                raise ValueError(f"the index was built with a different model, {self.manifest.meta['model_id']}")
            return
        if not model and not vocab:
            raise ValueError("a new index needs model='name' or vocab='file'")
        if vocab:
            self._init(read_vocab_file(vocab), {}, EXTERNAL, **options)
        else:
            encoder = models.get_model(str(model))
            self._init(encoder.vocab(), encoder.query_weights(), str(model), **options)

    @classmethod
    def create(cls, spark: SparkSession, path: str, model: str, **options) -> SparseIndex:
        return cls(spark, path, model=model, **options)

    @classmethod
    def create_external(cls, spark: SparkSession, path: str, vocab: Iterable[str], **options) -> SparseIndex:
        """An index of term vectors that the caller supplies: no model, no table of query weights."""
        return cls.create_from(spark, path, list(vocab), {}, EXTERNAL, **options)

    @classmethod
    def create_from(cls, spark: SparkSession, path: str, tokens: list[str] | DataFrame, weights: dict[int, float] | DataFrame, model_id: str, **options) -> SparseIndex:
        ix = cls.__new__(cls)
        ix.spark, ix.store = spark, Store(spark, path)
        if ix.store.exists():
            ix.reload()
            if ix.manifest.meta["model_id"] != model_id:
                raise ValueError(f"the index was built with a different model, {ix.manifest.meta['model_id']}")
        else:
            ix._init(tokens, weights, model_id, **options)
        return ix

    def _init(self, tokens: list[str] | DataFrame, weights: dict[int, float] | DataFrame, model_id: str, weight_mode: str = "u8", weight_scale: float = WEIGHT_SCALE, max_seq: int = MAX_SEQ, analyzer: str = "wordpiece", **hashes: str) -> None:
        if weight_mode not in ("u8", "f32"):
            raise ValueError("weight_mode must be u8 or f32")
        if analyzer not in ("wordpiece", "ascii"):
            raise ValueError("analyzer must be wordpiece or ascii")
        if isinstance(tokens, DataFrame):
            table = tokens.select(F.col("term").cast("int"), "token")
        else:
            table = vocab_frame(self.spark, check_tokens(tokens))
        name = self.store.write(table.repartitionByRange("term").sortWithinPartitions("term"), "vocab")
        n = check_table(self.store.read([name], VOCAB)) if isinstance(tokens, DataFrame) else len(tokens)
        qlut = weight_table(self.spark, weights)
        meta = {
            "format": FORMAT,
            "model_id": model_id,
            "weight_mode": weight_mode,
            "weight_scale": str(float(weight_scale)),
            "ndocs": "0",
            "vocab_table": name,
            "n_tokens": str(n),
            "analyzer": analyzer,
            "max_seq": str(max_seq),
            "created_utc": datetime.now(UTC).isoformat(timespec="seconds"),
        }
        if model_id != EXTERNAL:
            meta |= {"vocab_sha256": vocab_sha256(self.store.read([name], VOCAB) if isinstance(tokens, DataFrame) else tokens), **hashes}
        # nonzero weights only
        meta["qlut"] = self.store.write(qlut.where("qw <> 0"), "qlut")
        self.store.commit(Manifest(meta))
        self.reload()

    def reload(self) -> None:
        """Take up the current state of the folder; until then an index keeps to the state it opened."""
        self.manifest = self.store.load()
        self._tokens: list[str] | None = None

    # ---- tables

    @property
    def meta(self) -> dict[str, str]:
        return self.manifest.meta

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        return self.meta.get(key, default)

    def set_meta(self, key: str, value: str) -> None:
        self.reload()
        self.manifest.meta[key] = str(value)
        self.store.commit(self.manifest)

    @property
    def mode(self) -> str:
        return self.meta["weight_mode"]

    @property
    def scale(self) -> float:
        return float(self.meta["weight_scale"])

    @property
    def tokens(self) -> list[str]:
        """All tokens on the driver, as a WordPiece tokenizer needs them; of such vocabularies a file has 256 MB at most."""
        if self._tokens is None:
            self._tokens = [r["token"] for r in self.vocab.orderBy("term").select("token").toLocalIterator()]
        return self._tokens

    @property
    def vocab(self) -> DataFrame:
        return self.store.read([self.meta["vocab_table"]], VOCAB)

    def small(self, table: DataFrame) -> DataFrame:
        """A table of a row for each token or less, broadcast if there are few enough."""
        return F.broadcast(table) if int(self.meta["n_tokens"]) <= MAX_BROADCAST_TOKENS else table

    @staticmethod
    def few(table: DataFrame, n: int) -> DataFrame:
        """A table of n rows of ids and little else, broadcast if that is few enough."""
        return F.broadcast(table) if n <= MAX_BROADCAST_IDS else table

    @property
    def qlut(self) -> DataFrame:
        return self.store.read([self.meta["qlut"]], "term int, qw double")

    @property
    def postings(self) -> DataFrame:
        return self.store.read(self.manifest.postings, postings_schema(self.mode))

    @property
    def tombstones(self) -> DataFrame:
        return self.store.read(self.manifest.tombstones, TOMBSTONES)

    @property
    def docs(self) -> DataFrame:
        """All documents with their deleted mark."""
        rows = self.store.read(self.manifest.docs, DOCS)
        if not self.manifest.tombstones:
            return rows.withColumn("deleted", F.lit(False))
        gone = self.tombstones.distinct().withColumn("_gone", F.lit(True))
        return rows.join(gone, "id", "left").withColumn("deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")

    @property
    def live(self) -> DataFrame:
        rows = self.store.read(self.manifest.docs, DOCS)
        return rows.join(self.few(self.tombstones, self.tombstones.count()), "id", "left_anti") if self.manifest.tombstones else rows

    # ---- reading without a query

    def scan(self) -> DataFrame:
        """Every live id ascending, with a score of 0."""
        return self.live.select(F.col("id").alias("rowid"), F.lit(0.0).alias("score")).orderBy("rowid")

    def lookup(self, rowid: int) -> DataFrame:
        """The id if it is live."""
        rows = self.store.read(self.manifest.docs, DOCS).where(F.col("id") == rowid)
        return rows.join(self.tombstones.where(F.col("id") == rowid), "id", "left_anti").select(F.col("id").alias("rowid"), F.lit(0.0).alias("score"))

    def count(self) -> DataFrame:
        return self.live.agg(F.count("*").alias("n"))

    def deleted_ids(self) -> DataFrame:
        return self.docs.where("deleted").select("id")

    def posting(self, terms: list[int]) -> DataFrame:
        """The postings of some terms: folders and row groups of other terms are not read."""
        if not terms:
            return self.postings.where("false")
        return self.postings.where(F.col("tb").isin(sorted({t % BUCKETS for t in terms})) & F.col("term").isin(terms))

    def info(self) -> dict:
        m = self.manifest
        return {"model": m.meta["model_id"], "ndocs": int(m.meta["ndocs"]), "live_docs": self.count().first()[0], "pending": self.pending_count(), "weight_mode": self.mode, "generation": m.generation}

    # ---- queries

    def _words(self, text: Column) -> Column:
        if self.meta["analyzer"] == "ascii":
            return F.slice(ascii_words(text), 1, MAX_QUERY_TERMS)
        ship(self.spark)
        return token_ids(text, self.tokens)

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        """(qid, term, qw) of queries(qid, text): weights of the tokens, repeats added, zeros dropped."""
        self._need_weights()
        words = queries.select("qid", F.explode(self._words(F.col("text"))).alias("t"))
        if self.meta["analyzer"] == "ascii":
            words = words.join(self.small(self.vocab), F.col("t") == F.col("token")).select("qid", "term")
        else:
            words = words.select("qid", F.col("t").alias("term"))
        return words.join(self.small(self.qlut), "term").groupBy("qid", "term").agg(F.sum("qw").alias("qw")).where("qw <> 0")

    def encode_query(self, text: str) -> dict[str, float]:
        """{token: weight} of one text."""
        one = self.spark.range(1).select(F.col("id").alias("qid"), F.lit(text).alias("text"))
        return {r["token"]: r["qw"] for r in self.encode_queries(one).join(self.vocab, "term").collect()}

    def encode_vectors(self, queries: DataFrame, column: str = "terms") -> DataFrame:
        """(qid, term, qw) of queries(qid, terms JSON)."""
        return query_vectors(queries, column, self.small(self.vocab), ["qid"])

    def _need_weights(self) -> None:
        if self.meta["model_id"] == EXTERNAL:
            raise ValueError("no query weight table: this index takes term vectors, use match_terms")

    def _in_range(self, postings: DataFrame) -> DataFrame:
        """Postings of the ids that this index has given, 1 to ndocs; a foreign file may hold others."""
        return postings.where(F.col("doc_id").between(1, int(self.meta["ndocs"])))

    def score(self, terms: DataFrame, postings: DataFrame | None = None, queries: int | None = None) -> DataFrame:
        """(qid, rowid, score) of live documents for query vectors terms(qid, term, qw).

        queries: how many there are at most, if known; each has MAX_QUERY_TERMS terms at most.
        """
        terms = terms.select("qid", "term", "qw", F.pmod("term", F.lit(BUCKETS)).alias("tb"))
        if (queries is not None and queries * MAX_QUERY_TERMS <= MAX_BROADCAST_TERMS) or terms.count() <= MAX_BROADCAST_TERMS:
            terms = F.broadcast(terms)
        got = scores(self._in_range(self.postings if postings is None else postings), terms, self.mode, self.scale)
        return got.join(self.tombstones.withColumnRenamed("id", "rowid"), "rowid", "left_anti") if self.manifest.tombstones else got

    @staticmethod
    def _terms(vector: DataFrame) -> list[tuple[int, float]]:
        terms = [(r["term"], r["qw"]) for r in vector.limit(MAX_QUERY_TERMS + 1).collect()]
        if len(terms) > MAX_QUERY_TERMS:
            raise ValueError(f"a query has more than {MAX_QUERY_TERMS} terms")
        return terms

    def _one(self, vector: DataFrame, k: int | None, limit: int | None, offset: int) -> DataFrame:
        """A single query: its few terms come to the driver, so that only their postings are read."""
        terms = self._terms(vector)
        if not terms:
            return self.spark.range(0).selectExpr("id as rowid", "cast(0 as double) as score", "cast(0 as int) as rank")
        rows = self.spark.createDataFrame([(0, t, w) for t, w in terms], "qid int, term int, qw double")
        got = scores(self._in_range(self.posting([t for t, _ in terms])), F.broadcast(rows), self.mode, self.scale)
        if self.manifest.tombstones:
            got = got.join(self.tombstones.withColumnRenamed("id", "rowid"), "rowid", "left_anti")
        best = top_k(got.select("rowid", "score"), effective_k(k, limit, offset))
        if limit is not None and limit > 0:
            best = best.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
        return best

    def match(self, text: str | None, k: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """(rowid, score, rank) of the documents nearest to a text; null matches nothing. Filters put on the result
        apply to these k."""
        self._need_weights()
        one = self.spark.range(1).select(F.col("id").alias("qid"), F.lit(text).cast("string").alias("text"))
        return self._one(self.encode_queries(one), k, limit, offset)

    def match_terms(self, terms: dict[str, float] | str | None, k: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """(rowid, score, rank) for a vector of token weights, as a dict or as JSON."""
        import json

        text = json.dumps(terms) if isinstance(terms, dict) else terms
        one = self.spark.range(1).select(F.col("id").alias("qid"), F.lit(text).cast("string").alias("terms"))
        return self._one(self.encode_vectors(one), k, limit, offset)

    def match_batch(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(qid, rowid, score, rank) for queries(qid, text): one scan of the postings for all of them."""
        return self._batch(self.encode_queries(queries), queries, effective_k(k))

    def match_terms_batch(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(qid, rowid, score, rank) for queries(qid, terms JSON)."""
        return self._batch(self.encode_vectors(queries), queries, effective_k(k))

    def _batch(self, terms: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """By blocks of documents where the index has them and the batch is small enough to go to every task, else by
        joins and sums."""
        by_block = self._by_block(terms, k)
        scored = self.score(terms, queries=queries.count()) if by_block is None else by_block
        return top_k(scored.select("qid", "rowid", "score"), k, ("qid",))

    def _by_block(self, terms: DataFrame, k: int) -> DataFrame | None:
        """(qid, rowid, score) of the k best documents of each block, or None where that layout cannot be used."""
        m = self.manifest
        if not m.blocks or m.blocked != m.postings:
            return None
        rows = terms.select("qid", "term", "qw").limit(MAX_BLOCK_TERMS + 1).toArrow()
        if rows.num_rows > MAX_BLOCK_TERMS or (m.tombstones and self.tombstones.limit(MAX_BLOCK_DELETED + 1).count() > MAX_BLOCK_DELETED):
            return None
        ids = rows.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
        q = ids.indices.to_numpy()
        order = np.argsort(q, kind="stable")
        names = pa.table({"q": pa.array(np.arange(len(ids.dictionary), dtype=np.int32)), "qid": ids.dictionary})
        names = self.spark.createDataFrame(names, StructType([StructField("q", IntegerType()), StructField("qid", terms.schema["qid"].dataType)]))
        starts = np.searchsorted(q[order], np.arange(len(ids.dictionary) + 1))
        term, weight = (rows.column(c).to_numpy()[order] for c in ("term", "qw"))
        blocks = self.store.read(m.blocks, blocks_schema(self.mode))
        if m.tombstones:
            first = F.col("id") - 1
            gone = self.tombstones.distinct().groupBy(F.floor(first / BLOCK).alias("block")).agg(F.collect_list((first % BLOCK).cast("smallint")).alias("gone"))
            blocks = blocks.join(F.broadcast(gone), "block", "left")
        else:
            blocks = blocks.withColumn("gone", F.lit(None).cast("array<smallint>"))
        ship(self.spark)
        got = block_tops(blocks, starts, term, weight, k, divisor(self.mode, self.scale))
        return got.join(F.broadcast(names), "q").select("qid", "rowid", "score")

    def optimize(self) -> int:
        """Write the postings by blocks of documents too, for batches of queries; returns the number of blocks.

        Batches use it until documents are added or compacted; deletions are taken into account.
        """
        m = self.manifest
        ship(self.spark)
        # so many files that small tables are read by all cores, and large ones in files of a fair size
        parts = files_for(self.postings.count(), max(1, -(-int(self.meta["ndocs"]) // BLOCK)), self.spark.sparkContext.defaultParallelism)
        m.blocks = [self.store.write(block_postings(self._in_range(self.postings), parts), "blocks")]
        m.blocked = list(m.postings)
        self.store.commit(m)
        self.reload()
        return self.store.read(self.manifest.blocks, blocks_schema(self.mode)).count()

    def explain_match(self, text: str) -> DataFrame:
        """(qid, rowid, token, qw, w, part): what each term adds to the score of each live document."""
        one = self.spark.range(1).select(F.col("id").alias("qid"), F.lit(text).alias("text"))
        terms = self._terms(self.encode_queries(one))
        rows = self.spark.createDataFrame([(0, t, w, t % BUCKETS) for t, w in terms], "qid long, term int, qw double, tb int")
        held = self._in_range(self.posting([t for t, _ in terms]))
        if self.manifest.tombstones:
            held = held.join(self.tombstones.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
        return explain_scores(held, F.broadcast(rows), self.small(self.vocab), divisor(self.mode, self.scale))

    def hydrate(self, hits: DataFrame) -> DataFrame:
        """hits with ext_id and title; ids without a live document fall away."""
        rows = self.live.select(F.col("id").alias("rowid"), "ext_id", "title")
        return hits.join(rows, "rowid")

    def search(self, text: str, k: int | None = None, auto_sync: bool = False) -> DataFrame:
        """(id, ext_id, title, score) by rank."""
        if auto_sync and self.pending_count():
            self.sync()
        return self._named(self.match(text, k))

    def search_terms(self, terms: dict[str, float] | str, k: int | None = None) -> DataFrame:
        return self._named(self.match_terms(terms, k))

    def _named(self, hits: DataFrame) -> DataFrame:
        return self.hydrate(hits).select(F.col("rowid").alias("id"), "ext_id", "title", "score", "rank").orderBy("rank").drop("rank")

    # ---- writing

    def _save(self, docs: DataFrame, postings: DataFrame, gone: DataFrame | None = None, n_postings: int | None = None, **state) -> None:
        """One new generation of docs, postings and tombstones. n_postings: how many there are, about, if known."""
        m = self.manifest
        m.docs = [*m.docs, self.store.write(docs, "docs")]
        top = self.store.read(m.docs[-1:], DOCS).agg(F.max("id")).first()[0]
        m.postings = [*m.postings, self.store.write_postings(postings, n_postings, top or 0)]
        if gone is not None:
            m.tombstones = [*m.tombstones, self.store.write(gone, "tombstones")]
        m.meta["ndocs"] = str(max(int(m.meta["ndocs"]), top or 0))
        for k, v in state.items():
            setattr(m, k, v)
        self.store.commit(m)
        self.reload()

    def _assign(self, rows: DataFrame) -> DataFrame:
        """rows(id, ext_id, seq, ...) with ids: those given if positive, else the next ones in order of seq.

        Numbers come from counts by range of seq and a place within the range, so no task sorts all rows. Where many
        rows share a seq, _row parts them, if there is one.
        """
        base = max(int(self.meta["ndocs"]), rows.where("id > 0").agg(F.max("id")).first()[0] or 0)
        given = rows.where("id > 0")
        auto = rows.where("id is null or id <= 0")
        order = [c for c in ("seq", "_row") if c in auto.columns]
        auto = auto.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
        auto = self._materialize(auto, "assign")
        counts = auto.groupBy("_part").agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
        auto = auto.join(F.broadcast(counts), "_part").withColumn("id", F.lit(base) + F.col("_off") + place).drop("_part", "_off")
        both = given.unionByName(auto.select(given.columns)).withColumn("ext_id", F.coalesce("ext_id", F.col("id").cast("string")))
        return self._materialize(both, "assign")

    def _materialize(self, df: DataFrame, kind: str) -> DataFrame:
        """Through a table of this index, so that ids are decided once even if tasks run again."""
        name = self.store.write(df, f"tmp/{kind}")
        self.__dict__.setdefault("_tmp", []).append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.store.path}/{name}")

    def _clean(self) -> None:
        """Delete the tables of an operation that has ended."""
        for name in self.__dict__.pop("_tmp", []):
            self.store.delete(name)

    def _insert(self, rows: DataFrame, encode, cheap: bool = False, body: str = "body", **state) -> int:
        """rows(id?, ext_id?, title?, body?, meta?, seq?, payload...): the last of each ext_id is written, earlier versions die.

        encode(rows with id) gives (id, term, w, ntokens, truncated); if it is cheap, it is done anew for each use.
        body: the column that is kept as the body of a document.
        """
        if body != "body":
            # one copy of the texts is enough until the documents are written
            rows = rows.withColumn("body", F.lit(None).cast("string"))
        for c, kind in (("id", "long"), ("ext_id", "string"), ("title", "string"), ("body", "string"), ("meta", "string")):
            rows = rows.withColumn(c, F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind))
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.monotonically_increasing_id())
        # what the rows carry is written once; which of them count is settled on ids alone
        rows = self._materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        ids = self._assign(rows.select("_row", "id", "ext_id", "seq"))
        packed = F.struct("_row", "id", "ext_id")
        ids = self._materialize(ids.groupBy(F.col("ext_id").alias("_k")).agg(F.max_by(packed, "seq").alias("_r")).select("_r.*"), "latest")
        n = ids.count()
        total, unnumbered = rows.agg(F.count("*"), F.count(F.when(F.col("id").isNull() | (F.col("id") <= 0), 1))).first()
        if n == total and not unnumbered:
            # every row counts and has its id: the texts need not be shuffled to meet them
            best = rows.withColumn("ext_id", F.coalesce("ext_id", F.col("id").cast("string"))).drop("seq", "_row")
        else:
            best = rows.drop("id", "ext_id", "seq").join(self.few(ids, n), "_row").drop("_row")
        if not n:
            if state:
                for k, v in state.items():
                    setattr(self.manifest, k, v)
                self.store.commit(self.manifest)
                self.reload()
            self._clean()
            return 0
        taken = ids.join(self.store.read(self.manifest.docs, DOCS).select("id"), "id", "left_semi").limit(1).collect()
        if taken:
            raise ValueError(f"rowid {taken[0]['id']} is in use; rows deleted before are free again after compact()")
        encoded = encode(best) if cheap else self._materialize(encode(best), "encoded")
        per = encoded.groupBy("id").agg(F.max("ntokens").alias("ntokens"), F.max("truncated").alias("truncated"))
        docs = best.join(self.few(per, n), "id", "left").select("id", "ext_id", "title", F.col(body).cast("string").alias("body"), "meta", "ntokens", "truncated")
        old = self.live.join(self.few(ids.select("ext_id"), n), "ext_id", "left_semi").select("id") if self.manifest.docs else None
        weighted = encoded.where("term is not null and w > 0")
        postings = weighted.select("term", F.col("id").alias("doc_id"), quantize(F.col("w"), self.scale, self.mode).alias("w"))
        self._save(docs, postings, old, encoded.count(), **state)
        self._clean()
        return n

    def insert_terms(self, rows: DataFrame, column: str = "terms") -> int:
        """Write documents rows(id?, ext_id?, title?, terms JSON); an unknown token is an error. Returns how many."""
        if "text" in rows.columns:
            raise ValueError("give text or terms, not both")
        if column not in rows.columns:
            raise ValueError("text or terms is required")

        def encode(best: DataFrame) -> DataFrame:
            got = document_vectors(best, column, self.small(self.vocab), ["id"])
            return got.select("id", "term", "w", F.lit(None).cast("int").alias("ntokens"), F.lit(None).cast("boolean").alias("truncated"))

        return self._insert(rows, encode)

    def add_terms(self, ext_id: str, terms: dict[str, float], title: str = "") -> int:
        import json

        return self.insert_terms(self.spark.createDataFrame([(str(ext_id), title, json.dumps(terms))], "ext_id string, title string, terms string"))

    def encoder(self) -> Encoder:
        name = self.meta["model_id"]
        if self.query_only:
            raise ValueError("this index was opened for queries only")
        if name == EXTERNAL:
            raise ValueError("no model: this index takes term vectors only")
        encoder = models.get_model(name)
        self.check_model(encoder)
        return encoder

    def check_model(self, encoder: Encoder) -> None:
        """A model fits if its vocabulary is the index's and all its query weights are, within WEIGHT_TOLERANCE."""
        if models.vocab_hash(encoder) != (self.meta.get("vocab_sha256") or vocab_sha256(self.vocab)):
            raise ValueError("the index was built with a different model: the vocabularies differ")
        theirs = weight_table(self.spark, encoder.query_weights())
        if weight_differences(self.qlut, theirs).limit(1).count():
            raise ValueError("the index was built with a different model: the query weights differ")

    def insert_text(self, rows: DataFrame, store_body: bool = False) -> int:
        """Write documents rows(id?, ext_id?, title?, text) through the model of this index. Returns how many."""
        if "terms" in rows.columns:
            raise ValueError("give text or terms, not both")
        if "text" not in rows.columns:
            raise ValueError("text or terms is required")
        return self._insert(self._unstored(rows), self._encode_text(), body="text" if store_body else "body")

    def _encode_text(self):
        encoder = self.encoder()
        ship(self.spark)
        return lambda best: encoder.encode(best.select("id", "text"), self.small(self.vocab))

    @staticmethod
    def _unstored(rows: DataFrame) -> DataFrame:
        return rows.withColumn("body", F.lit(None).cast("string"))

    def add_encoded(self, rows: DataFrame) -> int:
        """Write documents rows(ext_id, title?, body?, terms map<int, double>) that were encoded elsewhere."""

        def encode(best: DataFrame) -> DataFrame:
            flat = best.select("id", F.explode_outer("terms").alias("term", "w"))
            return flat.select("id", F.col("term").cast("int"), F.col("w").cast("double"), F.lit(None).cast("int").alias("ntokens"), F.lit(None).cast("boolean").alias("truncated"))

        return self._insert(rows, encode, cheap=True)

    def build_bulk(self, rows: DataFrame, store_body: bool = False, words: DataFrame | None = None) -> int:
        """Write documents rows(id, ext_id, title, text) whose ids and ext_ids are unique and new: no upsert, no
        numbering, and the texts are read once. Returns how many.

        words: document_words of the same rows as a table, where there is one; the texts are not read then."""
        ship(self.spark)
        encoder = self.encoder()
        if words is None:
            encoded = self._materialize(encoder.encode(rows.select("id", "text"), self.small(self.vocab)), "encoded")
            per = encoded.groupBy("id").agg(F.max("ntokens").alias("ntokens"), F.max("truncated").alias("truncated"))
            n = encoded.count()
        else:
            encoded, per = word_terms(words, self.small(self.vocab)), words.select("id", "ntokens", "truncated")
            n = words.agg(F.sum(F.size("token"))).first()[0] or 0
        body = F.col("text") if store_body else F.lit(None).cast("string")
        docs = rows.select(F.col("id").cast("long"), F.col("ext_id").cast("string"), "title", body.alias("body"), F.lit(None).cast("string").alias("meta")).join(per, "id", "left")
        weighted = encoded.where("term is not null and w > 0")
        self._save(docs, weighted.select("term", F.col("id").alias("doc_id"), quantize(F.col("w"), self.scale, self.mode).alias("w")), n_postings=n)
        self._clean()
        return self.store.read(self.manifest.docs[-1:], DOCS).count()

    def update(self, *_args, **_kw) -> None:
        raise NotImplementedError("UPDATE not supported; DELETE then INSERT")

    def delete(self, ext_id: str | None = None, rowid: int | None = None, where: DataFrame | None = None) -> int:
        """Mark documents deleted, by ext_id, by id, or by a table of either. Returns how many were live."""
        live = self.live.select("id", "ext_id")
        if where is not None:
            key = "id" if "id" in where.columns else "ext_id"
            hit = live.join(where.select(F.col(key).cast("string" if key == "ext_id" else "long").alias(key)).distinct(), key, "left_semi")
        elif rowid is not None:
            hit = live.where(F.col("id") == rowid)
        else:
            hit = live.where(F.col("ext_id") == str(ext_id))
        name = self.store.write(hit.select("id"), "tombstones")
        n = self.store.read([name], TOMBSTONES).count()
        if n:
            self.manifest.tombstones = [*self.manifest.tombstones, name]
            self.store.commit(self.manifest)
            self.reload()
        return n

    def compact(self) -> int:
        """Rewrite postings and docs without what is deleted, as one generation. Returns the postings removed."""
        m = self.manifest
        if not m.tombstones:
            return 0
        before, n = self.postings.count(), self.tombstones.count()
        gone = self.few(self.tombstones.distinct().withColumnRenamed("id", "doc_id"), n)
        # beyond a broadcast, tasks join as many postings as they sort
        rows = self.postings if n <= MAX_BROADCAST_IDS else self.postings.repartition(max(1, -(-before // TASK_ROWS)), "doc_id")
        kept = rows.join(gone, "doc_id", "left_anti").select("term", "doc_id", "w")
        docs = self.live.select(*(c.split()[0] for c in DOCS.split(", ")))
        m.postings, m.docs, m.tombstones = [self.store.write_postings(kept, before, int(m.meta["ndocs"]))], [self.store.write(docs, "docs")], []
        self.store.commit(m)
        self.reload()
        return before - self.postings.count()

    # ---- queue

    def add(self, ext_id: str, text: str, title: str = "") -> None:
        self.queue(self.spark.createDataFrame([(str(ext_id), title, text)], "ext_id string, title string, body string"))

    def queue(self, rows: DataFrame) -> None:
        """Append rows(ext_id, title, body, seq?) to the pending queue, in order of seq."""
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.monotonically_increasing_id())
        m = self.manifest
        rows = rows.where("body is not null").select(F.lit(None).cast("long").alias("id"), "ext_id", F.coalesce("title", F.lit("")).alias("title"), "body", "seq")
        # the place in the queue: numbered as ids are, on from what was queued before
        kept, self.manifest.meta["ndocs"] = m.meta["ndocs"], str(m.queued)
        try:
            rows = self._assign(rows)
        finally:
            self.manifest.meta["ndocs"] = kept
        name = self.store.write(rows.select("id", "ext_id", "title", "body"), "pending")
        m.pending = [*m.pending, name]
        m.queued = max(m.queued, self.store.read([name], PENDING).agg(F.max("id")).first()[0] or 0)
        self._clean()
        self.store.commit(m)
        self.reload()

    @property
    def pending(self) -> DataFrame:
        return self.store.read(self.manifest.pending, PENDING).where(F.col("id") > self.manifest.drained)

    def pending_count(self) -> int:
        return self.pending.count()

    def clear_pending(self) -> None:
        self.manifest.drained, self.manifest.pending = self.manifest.queued, []
        self.store.commit(self.manifest)
        self.reload()

    def sync(self, batch_size: int | None = None, store_body: bool = False) -> int:
        """Write the pending queue in order. A batch leaves the queue in the same commit that writes its documents.

        Without batch_size the whole queue is one batch, which is what a cluster wants.
        """
        total = 0
        while True:
            batch = self.pending
            if batch_size:
                batch = batch.orderBy("id").limit(batch_size)
            last, n = batch.agg(F.max("id"), F.count("*")).first()
            if not n:
                return total
            rows = batch.select("ext_id", "title", F.col("body").alias("text"), F.col("id").alias("seq"))
            state = {"drained": last}
            if last == self.manifest.queued:
                state["pending"] = []
            self._insert(self._unstored(rows), self._encode_text(), body="text" if store_body else "body", **state)
            total += n

    commit = sync

    # ---- other files

    def clone(self, path: str) -> SparseIndex:
        """A new index at path with the state of this one. Its tables are shared, none is copied; changes of either are
        its own, since tables are never rewritten in place."""
        store = Store(self.spark, path)
        if store.exists():
            raise FileExistsError(path)
        m, full = self.manifest, self.store.full
        meta = m.meta | {k: full(m.meta[k]) for k in ("qlut", "vocab_table")}
        names = {k: [full(n) for n in getattr(m, k)] for k in ("postings", "docs", "tombstones", "pending", "blocks", "blocked")}
        store.commit(Manifest(meta, drained=m.drained, queued=m.queued, batches=dict(m.batches), **names))
        return SparseIndex(self.spark, path, query_only=self.query_only)

    def export_sqlite(self, path: str, format_name: str = "impactspark") -> None:
        """Write this index as a single SQLite file of version 1."""
        meta = {k: v for k, v in self.meta.items() if k not in ("qlut", "analyzer", "format", "vocab_table", "n_tokens")}
        ship(self.spark)
        sqlite_file.write_file(path, format_name, meta | {"vocab": vocab_json(self.tokens)}, self.qlut, self.postings, self.docs)

    @classmethod
    def import_sqlite(cls, spark: SparkSession, file: str, path: str, analyzer: str = "wordpiece") -> SparseIndex:
        """A new index at path from a single SQLite file of version 1. Postings of ids that have no document are left."""
        with sqlite_file.connect(file) as db:
            meta = sqlite_file.read_meta(db, file)
            n, low, high = db.execute("select count(*), min(id), max(id) from docs where id >= 1").fetchone()
            n_postings = (db.execute("select sum(length(docs)) from postings").fetchone()[0] or 0) // 4
        ship(spark)
        mode, scale = meta.get("weight_mode", "u8"), float(meta.get("weight_scale", WEIGHT_SCALE))
        weights = sqlite_file.read_table(spark, file, "qlut")
        ix = cls.create_from(spark, path, parse_vocab_json(meta["vocab"]), weights, meta["model_id"], weight_mode=mode, weight_scale=scale, analyzer=analyzer)
        docs = sqlite_file.read_table(spark, file, "docs")
        rows = sqlite_file.read_table(spark, file, "postings")
        if n and high - low + 1 == n:
            # ids without gaps: a range says as much as a join
            rows = rows.where(F.col("doc_id").between(low, high))
        else:
            rows = rows.join(docs.select(F.col("id").alias("doc_id")).where("id >= 1"), "doc_id", "left_semi")
        w = quantize(F.col("w"), scale, mode)
        gone = docs.where("deleted").select("id")
        ix._save(docs.drop("deleted").select(*(c.split()[0] for c in DOCS.split(", "))), rows.select("term", "doc_id", w.alias("w")), gone, n_postings)
        return ix


def weight_table(spark: SparkSession, weights: dict[int, float] | DataFrame) -> DataFrame:
    """(term, qw) of query weights."""
    if isinstance(weights, DataFrame):
        return weights.select(F.col("term").cast("int"), F.col("qw").cast("double"))
    return spark.createDataFrame([(int(t), float(w)) for t, w in weights.items()], "term int, qw double")


def weight_differences(a: DataFrame, b: DataFrame, tolerance: float = WEIGHT_TOLERANCE) -> DataFrame:
    """(term, a, b) where two tables of query weights differ."""
    x, y = a.select("term", F.col("qw").alias("a")), b.where("qw <> 0").select("term", F.col("qw").alias("b"))
    return x.join(y, "term", "full").where(F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, F.lit(True)))


def query_pieces(tokens: list[str], text: str) -> list[str]:
    """The tokens of a text, on the driver."""
    return [tokens[i] for i in WordPiece(tokens).encode(text)]
