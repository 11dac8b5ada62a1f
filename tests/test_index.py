import json
import os

import numpy as np
import pytest
from conftest import KNOWN, fake_encode, hits, put, small_vocab
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from impactspark.functions import models
from impactspark.functions.encoders import FunctionEncoder, LexicalEncoder
from impactspark.functions.models import register_model, unregister_model
from impactspark.operators.index import SparseIndex
from impactspark.sources.vocabulary import build_vocab


def encoded(spark, ix, rows):
    return ix.add_encoded(spark.createDataFrame(rows, "ext_id string, title string, terms map<int,double>"))


CORPUS = [("d1", "maple study", {10: 2.3, 11: 2.1, 12: 2.9, 17: 1.4}), ("d2", "far south", {15: 2.2, 14: 2.5}), ("d3", "hardly", {10: 0.4})]


def test_ranking_repeats_and_delete(spark, index):
    assert encoded(spark, index, CORPUS) == 3
    assert hits(index.match("maple river stone")) == [(1, 10.95), (3, 0.6)]
    assert index.encode_query("river river") == {"river": 3.0}
    assert index.match("zzzqqq").count() == 0
    assert index.match(None).count() == 0
    assert len(hits(index.match("maple river stone", k=1))) == 1
    assert index.delete("d1") == 1 and index.delete("d1") == 0
    assert hits(index.match("maple river stone")) == [(3, 0.6)]
    assert [r["ext_id"] for r in index.search("south").collect()] == ["d2"]


def test_empty_index(spark, index):
    assert index.match("river").count() == 0
    assert index.scan().count() == 0 and index.compact() == 0 and index.sync() == 0
    assert index.info()["live_docs"] == 0


def test_ties_go_to_the_lower_id_across_terms(spark, index):
    put(spark, index, ["north south"] * 6)
    assert hits(index.match("south", k=4)) == [(i, 3.0) for i in (1, 2, 3, 4)]
    other = SparseIndex(spark, index.store.path + "2", model="fake")
    other.add_encoded(spark.createDataFrame([(5, "a", {14: 2.0}), (2, "b", {15: 2.0})], "id long, ext_id string, terms map<int,double>"))
    assert hits(other.match("north south")) == [(2, 3.0), (5, 3.0)]


def test_k_limit_offset(spark, index):
    put(spark, index, ["river stone maple", "river", "river river stone", "north south", "stone"])
    want = [(1, 6.0), (3, 6.0), (2, 3.0)]
    assert hits(index.match("river stone", k=3)) == want
    assert hits(index.match("river stone", limit=3)) == want
    assert hits(index.match("river stone", k=0)) == want + [(5, 3.0)]
    assert hits(index.match("river stone", k=4, limit=2)) == want[:2]
    assert hits(index.match("river stone", limit=2, offset=2)) == [(2, 3.0), (5, 3.0)]


def test_filters_apply_after_k(spark, index):
    put(spark, index, ["river stone", "river", "river", "river"])
    assert index.match("river stone", k=2).where("rowid >= 2").count() == 1


def test_delete_count_scan_lookup(spark, index):
    put(spark, index, ["river stone maple", "river stone symptoms"])
    assert [r["rowid"] for r in index.scan().collect()] == [1, 2]
    assert index.delete(rowid=1) == 1
    assert [r["rowid"] for r in index.scan().collect()] == [2]
    assert index.count().first()[0] == 1
    assert index.lookup(1).count() == 0 and index.lookup(2).count() == 1 and index.lookup(9).count() == 0
    assert [r["id"] for r in index.deleted_ids().collect()] == [1]


@pytest.mark.parametrize("mode", ["u8", "f32"])
def test_compact_keeps_results(spark, tmp_path, fake_model, mode):
    ix = SparseIndex(spark, str(tmp_path / "ix"), model=fake_model, weight_mode=mode)
    put(spark, ix, ["river stone maple", "north south"] * 3)
    assert ix.postings.count() == 15
    ix.delete(where=spark.createDataFrame([(1,), (2,)], "id long"))
    before = hits(ix.match("river south"))
    assert ix.compact() == 5 and ix.postings.count() == 10
    assert hits(ix.match("river south")) == before
    assert ix.compact() == 0
    assert ix.meta["ndocs"] == "6"


def test_quantisation_bounds_and_mode(spark, index, tmp_path):
    encoded(spark, index, [("a", "", {10: 0.001, 11: 99.0, 12: 0.3625, 13: -1.0})])
    # 0.3625 * 40 is 14.5 in double precision and a little more in single
    assert {r["term"]: r["w"] for r in index.postings.collect()} == {10: 1, 11: 255, 12: int(np.rint(np.float32(0.3625) * np.float32(40)))}
    ix = SparseIndex(spark, str(tmp_path / "f"), model="fake", weight_mode="f32")
    encoded(spark, ix, [("a", "", {10: 2.5})])
    assert ix.postings.first()["w"] == 2.5 and hits(ix.match("river")) == [(1, 3.75)]


def test_upsert_last_version_wins(spark, index):
    encoded(spark, index, [("d1", "", {10: 2.0})])
    encoded(spark, index, [("d1", "", {11: 2.0})])
    assert index.docs.where("deleted").count() == 1 and index.live.count() == 1
    assert index.match("river").count() == 0 and len(hits(index.match("stone"))) == 1
    rows = [("d2", 1, {10: 1.0}), ("d2", 2, {11: 1.0})]
    index.add_encoded(spark.createDataFrame(rows, "ext_id string, seq long, terms map<int,double>"))
    assert index.match("river").count() == 0


def test_reinsert_after_delete(spark, index):
    encoded(spark, index, [("d1", "", {10: 2.0})])
    index.delete("d1")
    encoded(spark, index, [("d1", "", {10: 2.0})])
    assert hits(index.match("river")) == [(2, 3.0)]
    with pytest.raises(ValueError, match="in use"):
        index.add_encoded(spark.createDataFrame([(2, "x", {10: 1.0})], "id long, ext_id string, terms map<int,double>"))


def test_auto_ids_follow_order(spark, index):
    rows = [(None, f"e{i}", i, {10: 1.0}) for i in range(50)] + [(0, "zero", 50, {10: 1.0}), (-5, "neg", 51, {10: 1.0})]
    index.add_encoded(spark.createDataFrame(rows, "id long, ext_id string, seq long, terms map<int,double>").repartition(7))
    assert [r["ext_id"] for r in index.live.orderBy("id").collect()] == [f"e{i}" for i in range(50)] + ["zero", "neg"]
    assert index.live.agg(F.max("id")).first()[0] == 52


def test_queue_and_sync(spark, index):
    for i in range(7):
        index.add(f"q{i}", "north south")
    assert index.pending_count() == 7 and index.search("south").count() == 0
    assert index.sync(batch_size=3) == 7 and index.pending_count() == 0
    index.add("late", "river")
    assert index.search("river", auto_sync=True).count() == 1
    index.add("x", "river")
    index.clear_pending()
    assert index.pending_count() == 0 and index.sync() == 0


def test_failed_sync_keeps_the_queue(spark, tmp_path):
    def broken(text):
        raise RuntimeError("model fell over")

    register_model("broken", FunctionEncoder("broken", small_vocab(), {10: 1.5}, broken))
    try:
        ix = SparseIndex(spark, str(tmp_path / "ix"), model="broken")
        ix.add("a", "river")
        with pytest.raises(PySparkException):
            ix.sync()
        again = SparseIndex(spark, str(tmp_path / "ix"))
        assert again.pending_count() == 1 and again.live.count() == 0
    finally:
        unregister_model("broken")


def test_nothing_temporary_stays(spark, index, tmp_path):
    encoded(spark, index, CORPUS)
    index.add("q", "river")
    index.sync()
    assert not list((tmp_path / "ix" / "tmp").rglob("*.parquet"))


def test_readers_keep_their_snapshot(spark, index):
    encoded(spark, index, CORPUS)
    reader = SparseIndex(spark, index.store.path)
    index.delete("d1")
    assert reader.live.count() == 3
    reader.reload()
    assert reader.live.count() == 2


def test_open_errors(spark, tmp_path, fake_model):
    with pytest.raises(ValueError, match="needs model=.name. or vocab="):
        SparseIndex(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="not both"):
        SparseIndex(spark, str(tmp_path / "a"), model="fake", vocab="x")
    with pytest.raises(LookupError, match="not registered"):
        SparseIndex(spark, str(tmp_path / "a"), model="nobody")
    SparseIndex(spark, str(tmp_path / "a"), model="fake")
    with pytest.raises(ValueError, match="only applies when creating"):
        SparseIndex(spark, str(tmp_path / "a"), vocab="x")
    with pytest.raises(ValueError, match="different model"):
        SparseIndex(spark, str(tmp_path / "a"), model="other")
    with pytest.raises(NotImplementedError, match="UPDATE not supported"):
        SparseIndex(spark, str(tmp_path / "a")).update()


def test_foreign_format_is_refused(spark, index):
    index.set_meta("format", "other/9")
    with pytest.raises(ValueError, match="not a"):
        SparseIndex(spark, index.store.path)


def test_insert_arguments(spark, index):
    with pytest.raises(ValueError, match="not both"):
        index.insert_text(spark.createDataFrame([("a", "{}")], "text string, terms string"))
    with pytest.raises(ValueError, match="is required"):
        index.insert_text(spark.createDataFrame([("a",)], "ext_id string"))


def test_changed_model_is_refused(spark, index):
    other = small_vocab()
    other[30] = "new"
    register_model("fake", FunctionEncoder("fake", other, dict.fromkeys(KNOWN.values(), 1.5), fake_encode))
    with pytest.raises(ValueError, match="vocabularies differ"):
        put(spark, index, ["river"])
    register_model("fake", FunctionEncoder("fake", small_vocab(), {10: 1.5}, fake_encode))
    with pytest.raises(ValueError, match="query weights differ"):
        put(spark, index, ["river"])


def test_postings_are_pruned(spark, index):
    put(spark, index, ["river stone maple north"])
    plan = index.posting([10, 26])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tb" in plan or "tb#" in plan.split("PartitionFilters")[1][:60]
    assert "In(term" in plan


def test_explain_reads_few_postings_and_no_deleted_ones(spark, index):
    put(spark, index, ["river stone", "river", "maple"])
    index.delete(rowid=2)
    got = index.explain_match("river river stone")
    assert sorted((r["rowid"], r["token"], r["qw"], r["part"]) for r in got.collect()) == [(1, "river", 3.0, 6.0), (1, "stone", 1.5, 3.0)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [tb" in plan and "PushedFilters: [In(term" in plan
    assert index.explain_match("nothing").count() == 0


def test_a_clone_shares_tables_and_changes_alone(spark, index, tmp_path):
    put(spark, index, ["river stone", "river", "maple"])
    twin = index.clone(str(tmp_path / "twin"))
    assert hits(twin.match("river")) == hits(index.match("river")) and not os.path.exists(tmp_path / "twin" / "postings")
    twin.delete(rowid=1)
    assert twin.compact() > 0
    twin.insert_text(spark.createDataFrame([("new", "river")], "ext_id string, text string"))
    assert hits(twin.match("river")) == [(2, 3.0), (4, 3.0)] and hits(index.match("river")) == [(1, 3.0), (2, 3.0)]
    with pytest.raises(FileExistsError):
        index.clone(str(tmp_path / "twin"))


def test_opened_for_queries_only(spark, index):
    put(spark, index, ["river stone", "river"])
    models.unregister_model("fake")
    reader = SparseIndex(spark, index.store.path, query_only=True)
    assert hits(reader.match("stone")) == [(1, 3.0)] and reader.count().first()[0] == 2
    with pytest.raises(ValueError, match="queries only"):
        reader.insert_text(spark.createDataFrame([("x", "river")], "ext_id string, text string"))
    assert reader.insert_terms(spark.createDataFrame([("x", '{"stone": 4}')], "ext_id string, terms string")) == 1
    assert reader.delete(rowid=1) == 1 and hits(reader.match("stone")) == [(3, 6.0)]


def test_a_large_vocabulary_is_joined_by_shuffle(spark, tmp_path, monkeypatch):
    tokens = spark.range(300).selectExpr("cast(id as int) as term", "concat('w', char(97 + id % 26), char(97 + id div 26)) as token")
    weights = tokens.selectExpr("term", "1.0 + term % 3 as qw")
    rows = tokens.selectExpr("term + 1 as id", "token as ext_id", "'' as title", "concat(token, ' wab wac ', token) as text")
    got = []
    for n, most in enumerate((10**6, 1)):
        monkeypatch.setattr("impactspark.operators.index.MAX_BROADCAST_TOKENS", most)
        ix = SparseIndex.create_from(spark, str(tmp_path / f"ix{n}"), tokens, weights, "many-words", analyzer="ascii")
        models.register_model("many-words", LexicalEncoder(ix.vocab, ix.qlut, "many-words"))
        assert ix.insert_text(rows.select("id", "ext_id", "text")) == 300
        query = spark.createDataFrame([(1, "wab zz"), (2, "wcd wef")], "qid int, text string")
        batch = ix.match_batch(query, k=5)
        assert ("strategy=broadcast" in ix.encode_queries(query)._jdf.queryExecution().optimizedPlan().toString()) == (most > 1)
        got.append([batch.orderBy("qid", "rank").collect(), hits(ix.match("wab")), hits(ix.match_terms({"wac": 2.0})), ix.meta["vocab_sha256"]])
    models.unregister_model("many-words")
    assert got[0] == got[1] and got[0][0]
    for bad, message in ((tokens.where("term <> 5"), "numbered"), (tokens.unionByName(tokens.where("term = 0").selectExpr("300 as term", "token")), "duplicate")):
        with pytest.raises(ValueError, match=message):
            SparseIndex.create_from(spark, str(tmp_path / message), bad, {}, "m")


def test_ids_beyond_the_count_are_not_scored(spark, index):
    put(spark, index, ["river", "river"])
    index.manifest.meta["ndocs"] = "1"
    query = spark.createDataFrame([(1, "river")], "qid int, text string")
    assert hits(index.match("river")) == [(1, 3.0)] and index.match_batch(query).count() == 1 and index.explain_match("river").count() == 1


def test_a_manifest_with_its_vocabulary_inside_opens(spark, index):
    put(spark, index, ["river"])
    m = index.store.load()
    tokens = index.tokens
    del m.meta["vocab_table"], m.meta["n_tokens"]
    m.meta["vocab"] = json.dumps(tokens)
    index.store.commit(m)
    again = SparseIndex(spark, index.store.path)
    assert again.tokens == tokens and hits(again.match("river")) == [(1, 3.0)] and "vocab" not in again.meta


def test_terms_are_numbered_by_code_point(spark):
    words = ["b", "a", "ab", "abc", "abcd", "abce", "zé", "é", "za", "z", "中"]
    rows = spark.createDataFrame([(w,) for w in words for _ in range(3)] + [("rare",)], "token string").repartition(5)
    got = build_vocab(rows, 3).orderBy("term").collect()
    assert [r["token"] for r in got] == sorted(words, key=str.encode) and [r["term"] for r in got] == list(range(len(words))) and {r["df"] for r in got} == {3}


@pytest.mark.parametrize("mode", ["u8", "f32"])
def test_blocks_of_documents_rank_as_joins_do(spark, tmp_path, mode):
    g = np.random.default_rng(3)
    tokens = small_vocab()
    ix = SparseIndex.create_external(spark, str(tmp_path / "ix"), tokens, weight_mode=mode)
    ids = [1, 2, 2047, 2048, 2049, 4096, 4097, 20_000, *range(100, 140), *range(5000, 5030)]
    rows = [(i, json.dumps({tokens[t]: int(w) / 8 for t, w in zip(g.choice(12, 4, replace=False), g.integers(1, 40, 4), strict=True)})) for i in ids]
    ix.insert_terms(spark.createDataFrame(rows, "id long, terms string"))
    ask = [(f"q{n}", json.dumps({tokens[t]: int(w) / 4 for t, w in zip(g.choice(14, 3, replace=False), g.integers(-1, 9, 3), strict=True)})) for n in range(30)] + [("none", "{}"), (None, json.dumps({tokens[1]: 1}))]
    queries = spark.createDataFrame(ask, "qid string, terms string")

    def ranked(k):
        return sorted(map(str, ix.match_terms_batch(queries, k).select("qid", "rowid", "score", "rank").collect()))

    want = {k: ranked(k) for k in (1, 7, 500)}
    assert ix.optimize() == 4 and ix.manifest.blocks
    assert "MapInArrow" in ix.match_terms_batch(queries, 7)._jdf.queryExecution().toString()
    assert {k: ranked(k) for k in want} == want
    ix.delete(where=spark.createDataFrame([(i,) for i in ids[::3]], "id long"))
    blocks = ix.manifest.blocks
    got = {k: ranked(k) for k in want}
    ix.manifest.blocks = []
    assert {k: ranked(k) for k in want} == got != want
    # what is added later is not in the blocks, which are then left alone
    ix.manifest.blocks = blocks
    ix.insert_terms(spark.createDataFrame([(30_000, json.dumps({tokens[1]: 5}))], "id long, terms string"))
    assert "MapInArrow" not in ix.match_terms_batch(queries, 7)._jdf.queryExecution().toString()
    twin = ix.clone(str(tmp_path / "twin"))
    twin.optimize()
    assert sorted(map(str, twin.match_terms_batch(queries, 5).collect())) == sorted(map(str, ix.match_terms_batch(queries, 5).collect()))
