"""Queries on tables that are larger than those of the driver in the way that matters, against their SQL."""

import os
import sqlite3
import uuid

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF, hits, put
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_queries import TABLES, same

from impactspark.functions.encoders import document_words, lexical_terms, term_maps, word_terms
from impactspark.operators.blocks import BLOCK, block_postings
from impactspark.operators.index import MAX_BROADCAST_TOKENS, SparseIndex
from impactspark.plans.queries import ORACLE_SQL, QUERIES
from impactspark.sources import sqlite_file
from impactspark.sources.layout import DOCS, Store
from impactspark.sources.vocabulary import vocab_frame, vocab_sha256


@pytest.fixture
def grown(spark, tmp_path):
    """grown(table=rows): a folder of the tables of SF, with those given in their place."""

    def make(**tables):
        d = tmp_path / uuid.uuid4().hex
        d.mkdir()
        for t in TABLES:
            if t in tables:
                tables[t].toPandas().to_parquet(d / f"{t}.parquet")
            else:
                os.symlink(f"{SF}/{t}.parquet", d / f"{t}.parquet")
        return str(d)

    return make


def equal(spark, d, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    same(QUERIES[name](spark, d).toPandas(), c.sql(ORACLE_SQL[name]).df())


def test_change_feed_of_keys_that_others_take(spark, grown):
    """Keys beyond 500,000 and 1,000,000: renamed parts take the keys of parts that are renamed or deleted."""
    part = spark.read.parquet(f"{SF}/part.parquet").limit(40)
    every = [part.withColumn("p_partkey", F.col("p_partkey") + n) for n in (0, 500_000, 1_000_000, 1_500_000)]
    rows = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    equal(spark, grown(part=rows), "change_feed")


def test_head_postings_of_long_documents(spark, grown):
    """More vectors of a label than a model's window has tokens, the greatest of them last."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("label is not null")
    long = rows.select((F.col("vec_id") + 10_000).alias("vec_id"), "embedding", F.lit(1).alias("label")).crossJoin(spark.range(600).select("id"))
    long = long.limit(600).select((F.col("vec_id") * 1000 + F.col("id")).alias("vec_id"), F.transform("embedding", lambda v: (v * (1 + F.col("id") / 100)).cast("float")).alias("embedding"), "label")
    equal(spark, grown(embeddings=rows.withColumn("label", F.col("label").cast("int")).unionByName(long)), "head_postings")


def test_lateral_calls_cut_to_k_before_they_shuffle(spark):
    """Only the postings are shuffled by document, then k rows of a query and span: no row for each query and document."""
    plan = QUERIES["match_lateral_sql"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(doc_id" not in plan and plan.count("hashpartitioning(span") == 1


def test_words_are_counted_where_they_are_read(spark):
    """No shuffle of words, with a vocabulary beyond half a million tokens too."""
    rows = spark.createDataFrame([(1, "B b a"), (2, None), (3, "zz zz"), (4, "a zz é")], "id long, text string")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "term int, token string")
    got = lexical_terms(rows, F.broadcast(vocab), 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    want = [(1, 1, 1.0, 3, True), (2, None, None, 0, False), (3, None, None, 2, False), (4, 0, 0.5, 2, False), (4, None, None, 2, False)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert MAX_BROADCAST_TOKENS >= 4_000_000


def test_tasks_sort_so_many_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("impactspark.sources.layout.TASK_ROWS", 100)
    store = Store(spark, str(tmp_path))
    name = store.write_postings(spark.range(2000).selectExpr("cast(id % 50 as int) as term", "id as doc_id", "cast(1 as smallint) as w"), 2000)
    assert len({f.name.split("-")[1] for f in (tmp_path / name).rglob("*.parquet")}) == 20
    assert store.read([name], "term int, doc_id long, w smallint, tb int").distinct().count() == 2000


def test_blocks_shuffle_packed_postings(spark):
    rows = spark.range(5000).selectExpr("cast(id % 7 as int) as term", "id + 1 as doc_id", "cast(1 + id % 200 as smallint) as w", "cast(0 as int) as tb")
    got = block_postings(rows, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    for r in got.collect():
        d = [x * 1 + r["block"] * BLOCK for x in r["docs"]]
        terms = [t for t, n in zip(r["terms"], r["sizes"], strict=True) for _ in range(n)]
        assert terms == [x % 7 for x in d] and r["ws"] == [1 + x % 200 for x in d] and r["terms"] == sorted(r["terms"])


def test_a_single_file_is_written_by_tasks(spark, index, tmp_path, monkeypatch):
    """Several parts, runs of a term from several generations, a deleted document and an id without document."""
    monkeypatch.setattr(sqlite_file, "PART_ROWS", 3)
    put(spark, index, ["river stone", "river maple", "stone south river"])
    index.insert_text(spark.createDataFrame([(9, "river"), (5, "river stone")], "id long, text string"))
    index.delete(rowid=2)
    seen = []
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda df, *a, real=DataFrame.toLocalIterator, **k: seen.append(df.columns) or real(df, *a, **k))
    index.export_sqlite(file := str(tmp_path / "one.db"))
    assert seen in ([], [["token"]]) and [p.name for p in tmp_path.iterdir() if p.name.startswith("one")] == ["one.db"]
    with sqlite3.connect(file) as db:
        got = {t: np.frombuffer(d, "<i4").tolist() for t, d in db.execute("select t, docs from postings")}
        assert got == {10: [1, 2, 3, 5, 9], 11: [1, 3, 5], 12: [2], 15: [3]}
        assert db.execute("select id, deleted from docs order by id").fetchall() == [(1, 0), (2, 1), (3, 0), (5, 0), (9, 0)]
    back = SparseIndex.import_sqlite(spark, file, str(tmp_path / "back"))
    assert hits(back.match("river stone")) == hits(index.match("river stone"))


def test_numbered_rows_are_not_joined_to_their_ids(spark, index, monkeypatch):
    """Texts with ids of their own are encoded as they lie; versions and rows without ids are joined as before."""
    plans, encode = [], index.encoder().encode
    monkeypatch.setattr(type(index.encoder()), "encode", lambda e, rows, vocab: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or encode(rows, vocab))
    put(spark, index, ["river stone", "river"])
    assert "Join" not in plans[-1]
    index.insert_text(spark.createDataFrame([("2", "stone stone", 1), ("2", "stone", 2)], "ext_id string, text string, seq long"))
    assert "Join" in plans[-1] and hits(index.match("stone")) == [(1, 3.0), (4, 3.0)] and index.count().first()[0] == 2


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_encoded_maps_are_made_where_the_words_are(spark):
    """Documents that go on over several batches are one map each, and nothing is shuffled for it."""
    texts = [(i, " ".join(f"{'ab'[j % 2]}{'xyz'[j % 3]}" for j in range(i % 7)) + " é ax" * (i % 5 == 0)) for i in range(40)]
    rows = spark.createDataFrame([*texts, (90, None), (91, "zz zz")], "id long, text string").coalesce(2)
    vocab = spark.createDataFrame([(n, a + b) for n, (a, b) in enumerate((a, b) for a in "ab" for b in "xyz")], "term int, token string")
    words = document_words(rows)
    assert sorted(map(tuple, word_terms(words, F.broadcast(vocab)).collect()), key=str) == sorted(map(tuple, lexical_terms(rows, F.broadcast(vocab)).collect()), key=str)
    terms = word_terms(words, F.broadcast(vocab)).where("term is not null")
    want = {}
    for r in terms.collect():
        want.setdefault(r["id"], {})[r["term"]] = r["w"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = term_maps(terms)
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) and {r["id"]: r["terms"] for r in rows} == want and not exchanges(got)


def test_encoded_rows_shuffle_postings_once(spark, monkeypatch):
    """Neither maps nor stored postings are shuffled to meet their ids and names, however small automatic broadcasts are, and the
    postings are written once."""
    written, real = [], Store.write
    monkeypatch.setattr(Store, "write", lambda store, df, kind: written.append((kind, exchanges(df) if "map<" in str(df.dtypes) or kind == "docs" else 0)) or real(store, df, kind))
    monkeypatch.setattr("impactspark.plans.queries._BUILT", {})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = QUERIES["encoded_rows"](spark, SF)
        assert not exchanges(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kinds = [k for k, _ in written]
    assert "tmp/encoded" not in kinds and kinds.count("tmp/rows") == 1 and all(n == 0 for k, n in written if k == "tmp/rows")


def test_versions_of_few_turns_are_numbered_by_many_tasks(spark, index, monkeypatch):
    """Rows that share their seq are spread, the texts are held once, and the last version stays."""
    seen, real = [], SparseIndex._materialize
    monkeypatch.setattr(SparseIndex, "_materialize", lambda ix, df, kind: seen.append((kind, real(ix, df, kind))) or seen[-1][1])
    monkeypatch.setattr(SparseIndex, "_clean", lambda ix: None)
    rows = spark.range(400).selectExpr("cast(id div 2 as string) as ext_id", "concat('river stone ', id) as text", "id % 2 as seq", "cast(null as long) as id").where("seq = 1 or ext_id % 3 = 0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert index.insert_text(rows, store_body=True) == 200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    table = dict(reversed(seen))
    first = next(df for kind, df in seen if kind == "assign")
    assert first.select("_part").distinct().count() >= 4 and first.groupBy("seq").agg(F.count_distinct("_part").alias("n")).agg(F.max("n")).first()[0] >= 3
    assert table["rows"].where("body is not null").count() == 0
    got = index.store.read(index.manifest.docs, DOCS)
    assert got.select("id").distinct().count() == 200 and got.where("body = concat('river stone ', 2 * ext_id + 1)").count() == 200


def test_the_hash_of_a_vocabulary_table_needs_few_rows(spark, monkeypatch):
    tokens = [f"t{n}é" for n in range(3000)]
    table, want, got = vocab_frame(spark, tokens).repartition(5), vocab_sha256(tokens), []
    frame = type(table)
    monkeypatch.setattr(frame, "toLocalIterator", lambda df, *a, real=frame.toLocalIterator, **k: (got.append(1) or r for r in real(df, *a, **k)))
    assert vocab_sha256(table) == want and 1 <= len(got) <= 10


def test_compaction_joins_as_many_postings_as_it_sorts(spark, index, monkeypatch):
    """Beyond a broadcast of deleted ids too; what was removed is known from the counts."""
    monkeypatch.setattr("impactspark.operators.index.MAX_BROADCAST_IDS", 3)
    monkeypatch.setattr("impactspark.operators.index.TASK_ROWS", 10)
    seen, real = [], Store.write_postings
    put(spark, index, ["river stone"] * 20 + ["maple"] * 15)
    index.delete(where=spark.range(3, 9))
    monkeypatch.setattr(Store, "write_postings", lambda store, rows, *a: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or real(store, rows, *a))
    joins, frame = [], type(index.postings)
    monkeypatch.setattr(frame, "join", lambda df, *a, real=frame.join, **k: joins.append(a[-1]) or real(df, *a, **k))
    assert index.compact() == 12 and index.compact() == 0 and joins and "left_semi" not in joins
    assert "REPARTITION_BY_NUM" in seen[0] and "hashpartitioning(doc_id" in seen[0] and ", 6)" in seen[0]
    assert index.postings.count() == 43 and index.count().first()[0] == 29 and not index.manifest.tombstones


def test_postings_are_sorted_by_one_number(spark, tmp_path, monkeypatch):
    """Folder, term and id in one: a single sort, files in order, the session's setting as it was; greater ids as before."""
    key, plans = "spark.sql.maxConcurrentOutputFileWriters", []
    store, before = Store(spark, str(tmp_path)), spark.conf.get(key)
    rows = spark.range(4000).selectExpr("cast(pmod(id * 7919, 53) as int) as term", "id + (case when id % 2 = 0 then 4294960000 else 0 end) as doc_id", "cast(1 as smallint) as w")
    frame = type(rows)
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda df, *a, real=frame.sortWithinPartitions: plans.append(a) or real(df, *a))
    for top, n in (((1 << 32) - 1, 1), (1 << 32, 3), (None, 3)):
        name = store.write_postings(rows, 4000, top)
        files = list((tmp_path / name).rglob("*.parquet"))
        tables = [pq.read_table(f, partitioning=None).select(["term", "doc_id"]).to_pandas() for f in files]
        assert len(plans[-1]) == n and sum(map(len, tables)) == 4000 and len({f.parent for f in files}) == 16
        assert all(list(t.itertuples(index=False)) == sorted(t.itertuples(index=False)) for t in tables)
    assert spark.conf.get(key) == before


def test_hits_are_joined_to_documents_where_those_are_read(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = QUERIES["match_then_join_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
