"""Column expressions for impacts: quantise once when a document is written, dequantise once after a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT_SCALE = 40.0


def quantize(w: Column, scale: float = WEIGHT_SCALE, mode: str = "u8") -> Column:
    """u8: round half to even in single precision, clamped to 1..255, as smallint (Spark has no unsigned byte). f32: as is."""
    if mode == "f32":
        return w.cast("float")
    if mode != "u8":
        raise ValueError(f"weight_mode must be u8 or f32, not {mode}")
    return F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.rint(w.cast("float") * F.lit(scale).cast("float")))).cast("smallint")


def divisor(mode: str, scale: float) -> float:
    """What a sum of query weight times stored weight is divided by."""
    return scale if mode == "u8" else 1.0


def scores(postings: DataFrame, terms: DataFrame, mode: str, scale: float, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, rowid, score > 0): the dot products of query vectors terms(keys, term, qw) with all documents.

    An equi-join on the term and one partial and final sum; a query term matches a posting at most once, since
    query vectors hold a term once. The division comes last, so sums of dyadic weights are exact in any order.
    """
    hit = postings.join(terms, [c for c in ("tb", "term") if c in terms.columns and c in postings.columns])
    total = F.sum(F.col("qw") * F.col("w")) / F.lit(divisor(mode, scale))
    return hit.groupBy(*keys, F.col("doc_id").alias("rowid")).agg(total.alias("score")).where("score > 0")
