"""Change capture. A feed of (op, seq, id, old_id, columns...) becomes documents and deletions of an index.

attach() backfills a table and then follows its feed; run() drains a stream into the index with foreachBatch. A
batch that was committed is recognised by its number when a stream repeats it after a failure, so every change is
applied once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from impactspark.operators.index import SparseIndex

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def joined_text(columns: Sequence[str]) -> Column:
    """The text of a row: its columns in order, nulls empty, one space between."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def backfill(table: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(ext_id, title, body) of every row of a table."""
    return table.select(F.col(id_col).cast("string").alias("ext_id"), F.lit("").alias("title"), joined_text(columns).alias("body"))


def attach(index: SparseIndex, table: DataFrame, columns: Sequence[str], id_col: str) -> None:
    """Queue all rows of a table that the index does not hold already or holds otherwise; sync() then writes them."""
    index.queue(backfill(table, columns, id_col))


def apply_changes(index: SparseIndex, changes: DataFrame, columns: Sequence[str], stream: str = "changes", batch: int | None = None) -> int:
    """Apply changes(op, seq, id, old_id, columns...) in order of seq; the last change of an id decides.

    A deletion, or an update that renames, kills the old id. Returns the documents written.
    """
    if batch is not None and index.manifest.batches.get(stream, -1) >= batch:
        return 0
    changes = index._materialize(changes, "changes")
    seq, op = F.col("seq"), F.lower("op")
    here = changes.select(F.col("id").cast("string").alias("ext_id"), seq, op.alias("op"), joined_text(columns).alias("text"))
    renamed = changes.where(op.eqNullSafe(UPDATE) & F.col("old_id").isNotNull() & (F.col("old_id").cast("string") != F.col("id").cast("string")))
    gone = renamed.select(F.col("old_id").cast("string").alias("ext_id"), seq, F.lit(DELETE).alias("op"), F.lit(None).cast("string").alias("text"))
    both = here.unionByName(gone)
    last = both.groupBy("ext_id").agg(F.max_by(F.struct("op", "text", "seq"), F.struct(seq, F.when(F.col("op") == DELETE, 0).otherwise(1))).alias("r")).select("ext_id", "r.*")
    last = index._materialize(last, "last")
    index.delete(where=last.where(F.col("op") == DELETE))
    rows = last.where(F.col("op") != DELETE).select("ext_id", F.lit("").alias("title"), "text", "seq")
    state = {"batches": {**index.manifest.batches, stream: batch}} if batch is not None else {}
    return index._insert(index._unstored(rows), index._encode_text(), **state)


def follow(index: SparseIndex, changes: DataFrame, columns: Sequence[str], checkpoint: str, name: str = "changes", available_now: bool = True) -> StreamingQuery:
    """Apply a stream of changes to the index."""

    def one(batch: DataFrame, number: int) -> None:
        index.reload()
        apply_changes(index, batch, columns, name, number)

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest(index: SparseIndex, docs: DataFrame, checkpoint: str, name: str = "docs", available_now: bool = True) -> StreamingQuery:
    """Write a stream of docs(id?, ext_id, title?, text, seq?) to the index, each batch once; later versions win."""

    def one(batch: DataFrame, number: int) -> None:
        index.reload()
        if index.manifest.batches.get(name, -1) < number:
            index._insert(index._unstored(batch), index._encode_text(), batches={**index.manifest.batches, name: number})

    writer = docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
