"""The DataFrame path, the batch path and the table function against a few lines of plain Python."""

import json

from conftest import small_vocab
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from impactspark.operators.index import SparseIndex

TOKENS = small_vocab()[10:16]
WEIGHT = st.integers(0, 300).map(lambda n: n / 40)
VECTOR = st.dictionaries(st.sampled_from(TOKENS), WEIGHT, max_size=4)


def oracle(docs, query, k):
    scores = {}
    for i, d in docs.items():
        s = sum(q * max(1, min(255, round(d[t] * 40))) for t, q in query.items() if q > 0 and d.get(t, 0) > 0)
        if s > 0:
            scores[i] = s / 40
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VECTOR, min_size=1, max_size=12), st.lists(VECTOR.map(lambda v: {t: round(w * 4) / 4 for t, w in v.items()}), min_size=1, max_size=4), st.sets(st.integers(1, 12), max_size=3), st.integers(1, 8))
def test_paths_agree(spark, tmp_path_factory, docs, queries, dead, k):
    ix = SparseIndex.create_external(spark, str(tmp_path_factory.mktemp("ix") / "ix"), small_vocab())
    ix.insert_terms(spark.createDataFrame([(i + 1, json.dumps(d)) for i, d in enumerate(docs)], "id long, terms string").repartition(3))
    ix.delete(where=spark.createDataFrame([(i,) for i in sorted(dead)] or [(0,)], "id long"))
    live = {i + 1: d for i, d in enumerate(docs) if i + 1 not in dead}
    q = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(queries)], "qid int, terms string")
    batch = ix.match_terms_batch(q, k).orderBy("qid", "rank").collect()
    for i, v in enumerate(queries):
        want = oracle(live, v, k)
        assert [(r["rowid"], r["score"]) for r in batch if r["qid"] == i] == want
    assert [(r["rowid"], r["score"]) for r in ix.match_terms(queries[0], k).orderBy("rank").collect()] == oracle(live, queries[0], k)
