import duckdb
import pytest
from conftest import SF

from impactspark.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    cols = sorted(left.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (left, right))
    assert len(a) == len(b)
    assert not ((a != b) & ~(a.isna() & b.isna())).any().any()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    same(QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
