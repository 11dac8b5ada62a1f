import pytest
from conftest import hits, small_vocab
from pyspark.errors import PySparkException

from impactspark.operators.index import SparseIndex


@pytest.fixture
def external(spark, tmp_path):
    return SparseIndex.create_external(spark, str(tmp_path / "ext"), small_vocab())


def put(spark, ix, rows):
    return ix.insert_terms(spark.createDataFrame(rows, "id long, terms string"))


def test_vectors_in_and_out(spark, external):
    put(spark, external, [(1, '{"river": 2.0, "stone": 1.5}'), (2, '{"river": 0.5, "south": 3}'), (3, '{"north": 1, "river": 0.0, "stone": -1}')])
    assert external.meta["ndocs"] == "3" and external.meta["model_id"] == "external"
    assert external.postings.where("doc_id = 3").count() == 1
    assert hits(external.match_terms({"river": 2.0, "stone": 1.0, "zzz": 9.0}, k=5)) == [(1, 11 / 2), (2, 1.0)]
    assert hits(external.match_terms('{"river": 1.0, "river": 1.0, "zzz": 4.0, "south": -1.0, "north": 0.0}')) == [(1, 4.0), (2, 1.0)]
    assert external.match_terms(None).count() == 0 and external.match_terms({}).count() == 0
    again = SparseIndex(spark, external.store.path)
    assert hits(again.match_terms({"south": 1.0})) == [(2, 3.0)]


def test_empty_vector_is_a_document(spark, external):
    assert put(spark, external, [(1, "{}")]) == 1 and external.live.count() == 1


@pytest.mark.parametrize("terms, message", [('{"nope": -1.0}', "not in the index vocabulary"), ("[1, 2]", "JSON object"), ("not json", "JSON object"), ('{"river": "high"}', "must be a number"), ('{"river": null}', "must be a number"), ('{"river": true}', "must be a number")])
def test_strict_errors(spark, external, terms, message):
    with pytest.raises(PySparkException, match=message):
        put(spark, external, [(1, terms)])
    assert SparseIndex(spark, external.store.path).live.count() == 0


@pytest.mark.parametrize("terms", ["[1]", "nope", '{"river": "x"}'])
def test_query_errors(spark, external, terms):
    with pytest.raises(PySparkException):
        external.match_terms(terms).collect()


def test_too_many_terms(spark, tmp_path):
    ix = SparseIndex.create_external(spark, str(tmp_path / "big"), [f"t{i}" for i in range(5000)])
    with pytest.raises(PySparkException, match="more than 512"):
        ix.match_terms({f"t{i}": 1.0 for i in range(513)}).collect()
    with pytest.raises(PySparkException, match="more than 4096"):
        ix.add_terms("a", {f"t{i}": 1.0 for i in range(4097)})


def test_text_needs_weights(spark, external):
    with pytest.raises(ValueError, match="query weight table"):
        external.match("river")
    with pytest.raises(ValueError, match="no model"):
        external.insert_text(spark.createDataFrame([("river",)], "text string"))


def test_batch(spark, external):
    put(spark, external, [(1, '{"river": 2.0}'), (2, '{"river": 2.0, "stone": 1}')])
    q = spark.createDataFrame([(7, '{"river": 1}'), (8, '{"stone": 2}'), (9, None)], "qid int, terms string")
    got = sorted((r["qid"], r["rowid"], r["score"]) for r in external.match_terms_batch(q, k=5).collect())
    assert got == [(7, 1, 2.0), (7, 2, 2.0), (8, 2, 2.0)]


def test_terms_equal_text(spark, index):
    from conftest import put as put_text

    put_text(spark, index, ["river stone maple", "river", "north south", "stone river river"])
    assert hits(index.match_terms({"river": 1.5, "stone": 1.5})) == hits(index.match("river stone")) and len(hits(index.match("river stone"))) == 3
