"""Term vectors: JSON objects of token weights, for documents (strict) and queries (lenient)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOC_TERMS = 4096
MAX_QUERY_TERMS = 512
_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _fail(text: Column | str) -> Column:
    return F.raise_error(text if isinstance(text, Column) else F.lit(text))


def explode_vector(rows: DataFrame, json_column: str, keys: list[str]) -> DataFrame:
    """(keys, token, weight) of a JSON column. Null gives no rows; what is not an object, or holds a weight that is
    not a number, is an error. Keys that repeat give a row each."""
    j = F.col(json_column)
    parsed = F.from_json(j, "map<string,variant>")
    checked = F.when(j.isNotNull() & parsed.isNull(), _fail(F.lit("a term vector must be a JSON object"))).otherwise(parsed)
    out = rows.select(*keys, F.explode(checked).alias("token", "_v"))
    kind = F.upper(F.schema_of_variant("_v"))
    weight = F.when(kind.rlike(_NUMBER), F.try_variant_get("_v", "$", "double")).otherwise(
        _fail(F.concat(F.lit("the weight of '"), F.col("token"), F.lit("' must be a number"))).cast("double")
    )
    return out.select(*keys, "token", weight.alias("weight"))


def query_vectors(rows: DataFrame, json_column: str, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, qw): unknown tokens and weights that are not positive fall away, repeats add up; more than
    MAX_QUERY_TERMS terms are an error."""
    got = explode_vector(rows, json_column, keys).join(vocab, "token").where("weight > 0")
    got = got.groupBy(*keys, "term").agg(F.sum("weight").alias("qw"))
    per = got.groupBy(*keys).agg(F.collect_list(F.struct("term", "qw")).alias("_t"))
    per = per.withColumn("_t", F.when(F.size("_t") > MAX_QUERY_TERMS, _fail(f"a query vector has more than {MAX_QUERY_TERMS} terms").cast(per.schema["_t"].dataType)).otherwise(F.col("_t")))
    return per.select(*keys, F.inline("_t"))


def document_vectors(rows: DataFrame, json_column: str, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, w): every token must be in the vocabulary, before its sign is looked at; weights that are not
    positive fall away, repeats add up; more than MAX_DOC_TERMS terms are an error."""
    got = explode_vector(rows, json_column, keys).join(vocab, "token", "left")
    # one expression, so that the vocabulary is asked before the sign of the weight
    pair = F.struct(F.col("term"), F.col("weight"))
    fail = _fail(F.concat(F.lit("terms not in the index vocabulary: "), F.col("token"))).cast("struct<term:int,weight:double>")
    got = got.select(*keys, F.when(F.col("term").isNull(), fail).when(F.col("weight") > 0, pair).alias("_p")).where("_p is not null").select(*keys, "_p.*")
    got = got.groupBy(*keys, "term").agg(F.sum("weight").alias("w"))
    n = got.groupBy(*keys).agg(F.count("*").alias("_n"), F.collect_list(F.struct("term", "w")).alias("_t"))
    full = F.when(F.col("_n") > MAX_DOC_TERMS, _fail(f"a term vector has more than {MAX_DOC_TERMS} terms").cast(n.schema["_t"].dataType)).otherwise(F.col("_t"))
    return n.select(*keys, F.inline(full))
