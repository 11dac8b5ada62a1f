import pytest
from conftest import hits, put

from impactspark.operators.index import SparseIndex
from impactspark.plans.sql import register_functions
from impactspark.streaming.sync import apply_changes, attach, follow, ingest

FEED = "op string, seq long, id string, old_id string, line1 string, city string"


def test_attach_and_changes(spark, index):
    table = spark.createDataFrame([(7, "maple lane", "south"), (8, "cloud street", None)], "id long, line1 string, city string")
    attach(index, table, ["line1", "city"], "id")
    assert index.sync(store_body=True) == 2
    assert sorted(r["body"] for r in index.live.collect()) == ["cloud street ", "maple lane south"]
    changes = [("update", 1, "8", "8", "cloud street", "river"), ("delete", 2, "7", None, None, None), ("insert", 3, "9", None, "north", ""), ("update", 4, "10", "9", "north", "river")]
    assert apply_changes(index, spark.createDataFrame(changes, FEED), ["line1", "city"]) == 2
    assert sorted(r["ext_id"] for r in index.live.collect()) == ["10", "8"]
    assert index.search("south").count() == 0 and index.search("river").count() == 2


def test_delete_then_insert_of_one_id(spark, index):
    changes = [("insert", 1, "1", None, "river", ""), ("delete", 2, "1", None, None, None), ("insert", 3, "1", None, "south", "")]
    apply_changes(index, spark.createDataFrame(changes, FEED), ["line1", "city"])
    assert index.search("south").count() == 1 and index.search("river").count() == 0


def test_streams_apply_each_batch_once(spark, index, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("a", "river"), ("b", "south")], "ext_id string, text string").write.parquet(feed)
    rows = spark.readStream.schema("ext_id string, text string").parquet(feed)
    for _ in range(2):
        ingest(index, rows, str(tmp_path / "cp")).awaitTermination()
    index.reload()
    assert index.live.count() == 2 and index.docs.count() == 2
    # a stream that lost its checkpoint repeats batch 0, which is known
    ingest(index, rows, str(tmp_path / "cp2")).awaitTermination()
    index.reload()
    assert index.docs.count() == 2
    changes = str(tmp_path / "changes")
    spark.createDataFrame([("delete", 1, "a", None, None, None)], FEED).write.parquet(changes)
    follow(index, spark.readStream.schema(FEED).parquet(changes), ["line1", "city"], str(tmp_path / "cp3")).awaitTermination()
    index.reload()
    assert [r["ext_id"] for r in index.live.collect()] == ["b"]


@pytest.mark.parametrize("external", [False, True])
def test_table_functions(spark, index, tmp_path, external):
    ix = index
    if external:
        ix = SparseIndex.create_external(spark, str(tmp_path / "e"), index.tokens)
        ix.insert_terms(spark.createDataFrame([(1, '{"river": 2.0, "stone": 2.0}'), (2, '{"river": 2.0}')], "id long, terms string"))
    else:
        put(spark, ix, ["river stone", "river", "gone river"])
        ix.delete(rowid=3)
    register_functions(spark, ix)
    one = spark.sql("""SELECT rowid, score FROM sparse_match_terms('{"river": 1.5, "stone": 1.5, "zz": 1}', 5)""").collect()
    assert sorted((r[0], r[1]) for r in one) == [(1, 6.0), (2, 3.0)]
    assert spark.sql("SELECT sparse_tokens('maples')").first()[0] == '["maple","##s"]'
    assert spark.sql("SELECT sparse_version()").first()[0].startswith("impactspark ")
    if not external:
        assert sorted(tuple(r) for r in spark.sql("SELECT * FROM sparse_match('river stone')").collect()) == [(1, 6.0), (2, 3.0)]
        assert spark.sql("SELECT * FROM sparse_match('river stone', 1)").count() == 1
        q = "SELECT q.id, m.rowid FROM VALUES (1, 'river'), (2, 'stone'), (3, 'zz') q(id, text), LATERAL sparse_match(q.text, 5) m"
        assert sorted(tuple(r) for r in spark.sql(q).collect()) == [(1, 1), (1, 2), (2, 1)]
        assert hits(ix.match("river stone")) == [(1, 6.0), (2, 3.0)]


def test_table_functions_read_few_postings(spark, index):
    put(spark, index, [f"river stone{n} north" for n in range(20)])
    register_functions(spark, index, max_queries=100)
    for q in ("SELECT * FROM sparse_match('river')", "SELECT * FROM sparse_match_terms('{\"river\": 1}')", "SELECT q.id, m.rowid FROM VALUES (1, 'river'), (2, 'stone') q(id, text), LATERAL sparse_match(q.text, 5) m"):
        df = spark.sql(q)
        df.collect()
        assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString(), q
    # with no bound on the queries their terms are not broadcast by a hint
    register_functions(spark, index, max_queries=10**9)
    assert "strategy=broadcast" not in spark.sql("SELECT q.id, m.rowid FROM VALUES (1, 'river') q(id, text), LATERAL sparse_match(q.text, 5) m")._jdf.queryExecution().analyzed().toString().split("sparse_postings")[0].split("SubqueryAlias v")[0]
