"""Sharding by k-d tree partitioning, in DataFrame operations alone.

A node holds documents; it is split along the metadata dimension in which it is widest, at the weighted median
of its bytes, until a leaf is down to the target bytes. Dimensions: bytes of the text (as a logarithm), the
language, and bytes per character, which all come from the text itself or go with it, so equal texts fall
together and are parted only where a cut has to go through them.

The weighted medians of all nodes of a level are found together and exactly. A row's key within its node is the
coordinate, the CRC of the text, the id, and the row's number in the table written at the start, which parts rows that are
equal otherwise. Where a node holds more than SORT_ROWS rows, a pass cuts the range of the first part of the key into at
most BINS bins, sums bytes by (node, bin), and goes on with the bin in which the median falls, then with the next part of
the key; what is left is sorted by node. So no task sorts more than SORT_ROWS rows or sums more than BINS bins a node,
whatever the input, and the cut is the one that sorting everything would give.

Slots follow (id, CRC, row number) within a shard, by a sort in ranges.

Nulls: a null text has no bytes, a null id orders first, a null language is the empty string. An empty table
gives an empty result. Rows that repeat are all placed, each with its own slot, and spread over shards as other rows are.
Only doc_id, text and lang are read; other columns don't matter.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactspark.llm.common import drop_table, running, save, scratch

#: More leaves than this make the table of nodes too large to broadcast.
MAX_LEAVES = 65_536
#: Rows of a node that one task sorts, and bins that a range of keys is cut into.
SORT_ROWS, BINS = 65_536, 65_536
DIMS = ("length", "lang", "density")
#: The parts of a key after the coordinate, with their least values and how many there can be.
PARTS = (("crc", 0, 1 << 32), ("id", -(1 << 63), 1 << 64), ("row", 0, 1 << 63))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, the coordinates, and what orders rows within a node, all integers."""
    text = F.col("text")
    chars = F.coalesce(F.char_length(text), F.lit(0))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.least(size, F.lit(2**32 - 1)).alias("length"),
        F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")).cast("long").alias("lang"),
        F.floor(size * 1000 / (chars + 1)).cast("long").alias("density"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver, as one JSON literal that the JVM reads."""
    names = [c.split()[0] for c in schema.split(", ")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{schema}>>")))


def _widest(r) -> str:
    width = {"length": log2(r["max_length"] / r["min_length"]) / 16, "lang": (r["max_lang"] - r["min_lang"]) / 2**32, "density": (r["max_density"] - r["min_density"]) / 3000}
    return max(DIMS, key=lambda d: width[d])


class _Search:
    """Where the median of one node is: at `depth` of the key, between `low` and `low` + `span`, after `fixed` parts."""

    def __init__(self, r, leaves: int):
        self.node, self.leaves, self.left = r["node"], leaves, leaves // 2
        self.total, self.rows, self.before = r["total"], r["rows"], 0
        self.dim = _widest(r)
        self.fixed: list[int] = []
        self.low, self.span = r[f"min_{self.dim}"], r[f"max_{self.dim}"] - r[f"min_{self.dim}"] + 1

    @property
    def width(self) -> int:
        return -(-self.span // BINS)

    def enter(self, b: int, before: int, rows: int) -> None:
        """Go on in bin b, which holds `rows` rows and has `before` bytes before it."""
        self.before += before
        self.rows = rows
        value, width = self.low + b * self.width, self.width
        if width > 1:
            self.low, self.span = value, min(width, self.low + self.span - value)
        else:
            self.fixed.append(value)
            _, self.low, self.span = PARTS[len(self.fixed) - 1]


_PART_NAMES = ("coord", *(p[0] for p in PARTS))


def _within(table: DataFrame, nodes: list[_Search]) -> DataFrame:
    """The rows among which the medians of some nodes are, with `value`, the part of the key looked at, and its bin."""
    schema = "node int, dim int, depth int, low long, width long, goal decimal(38,0), base long, k int, span decimal(20,0), " + ", ".join(f"f{i} long" for i in range(len(PARTS)))
    rows = [(s.node, DIMS.index(s.dim), len(s.fixed), s.low, s.width, s.total * s.left, s.before, s.leaves, s.span, *(s.fixed + [None] * len(PARTS))[: len(PARTS)]) for s in nodes]
    at = table.join(F.broadcast(_table(table.sparkSession, rows, schema)), "node")
    at = at.withColumn("coord", F.element_at(F.array(*DIMS), F.col("dim") + 1))
    at = at.withColumn("value", F.element_at(F.array(*_PART_NAMES), F.col("depth") + 1))
    for i, name in enumerate(_PART_NAMES[: len(PARTS)]):
        at = at.where(F.col(f"f{i}").isNull() | (F.col(f"f{i}") == F.col(name)))
    # in decimals, as a range of ids is wider than a long
    off = F.col("value").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")
    at = at.where((off >= 0) & (off < F.col("span")))
    return at.withColumn("bin", F.expr("(cast(value as decimal(20,0)) - cast(low as decimal(20,0))) div width").cast("int"))


def _medians(table: DataFrame, nodes: list[_Search]) -> list[tuple]:
    """(node, step, whether the median row belongs to the left, and its key) of each node."""
    while large := [s for s in nodes if s.rows > SORT_ROWS]:
        by = {s.node: s for s in large}
        sums = _within(table, large).groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.first("goal").alias("goal"), F.first("base").alias("base"), F.first("k").alias("k"))
        sums = sums.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin")))
        cut = sums.where((F.col("base") + F.col("upto")).cast("decimal(38,0)") * F.col("k") > F.col("goal"))
        for r in cut.groupBy("node").agg(F.min(F.struct("bin", "w", "n", "upto")).alias("c")).collect():
            by[r["node"]].enter(r["c"]["bin"], r["c"]["upto"] - r["c"]["w"], r["c"]["n"])
    order = W.partitionBy("node").orderBy(*_PART_NAMES).rowsBetween(W.unboundedPreceding, -1)
    last = _within(table, nodes).withColumn("b", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.where((F.col("b") + F.col("size")).cast("decimal(38,0)") * F.col("k") > F.col("goal"))
    left = (2 * F.col("b") + F.col("size")).cast("decimal(38,0)") * F.col("k") <= 2 * F.col("goal")
    got = last.groupBy("node").agg(F.min(F.struct(*_PART_NAMES, left.alias("left"))).alias("m")).collect()
    by = {s.node: s for s in nodes}
    return [(r["node"], by[r["node"]].left, DIMS.index(by[r["node"]].dim), r["m"]["left"], *(r["m"][p] for p in _PART_NAMES)) for r in got]


def kd_leaves(meta: DataFrame, leaves: int) -> DataFrame:
    """meta, written as a table, with the number of its leaf in `node`."""
    spark = meta.sparkSession
    if leaves > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves; shard by a coarser key first")
    table = save(meta.withColumn("node", F.lit(0)), "kd")
    # a node is (first leaf it holds, number of leaves)
    open_nodes: dict[int, int] = {0: leaves}
    while any(n > 1 for n in open_nodes.values()):
        ranges = [f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]
        stats = table.groupBy("node").agg(F.sum("size").alias("total"), F.count("*").alias("rows"), *ranges).collect()
        nodes = [_Search(r, open_nodes[r["node"]]) for r in stats if open_nodes[r["node"]] > 1]
        cuts = _medians(table, nodes) if nodes else []
        small = _table(spark, cuts, "node int, step int, dim int, left boolean, " + ", ".join(f"m_{p} long" for p in _PART_NAMES))
        moved = table.join(F.broadcast(small), "node", "left").withColumn("coord", F.element_at(F.array(*DIMS), F.col("dim") + 1))
        key, median = F.struct(*_PART_NAMES), F.struct(*(F.col(f"m_{p}").alias(p) for p in _PART_NAMES))
        lower = F.col("step").isNull() | (key < median) | F.col("left") & (key == median)
        node = F.when(lower, F.col("node")).otherwise(F.col("node") + F.col("step"))
        new = save(moved.withColumn("node", node.cast("int")).select(*table.columns), "kd")
        drop_table(spark, table)
        table = new
        halves = {k: n // 2 for k, n in open_nodes.items() if n > 1}
        open_nodes = {k: halves.get(k, n) for k, n in open_nodes.items()} | {k + h: open_nodes[k] - h for k, h in halves.items()}
    return table


def number(rows: DataFrame) -> DataFrame:
    """Add slot, gapless from 0 in each shard, in order of (id, crc, row)."""
    placed = running(rows, [F.col(c) for c in ("shard", "id", "crc", "row")], {}, "_at")
    # one row per shard, of which there are MAX_LEAVES at most
    first = rows.groupBy(F.col("shard").alias("_shard")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1))
    first = first.select("_shard", F.coalesce(upto, F.lit(0)).alias("_first"))
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).withColumn("slot", (F.col("_at") - F.col("_first") - 1).cast("long"))
    out._scratch_path = placed._scratch_path  # type: ignore[attr-defined]
    return out


def kd_shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Give the number of leaves, or the bytes that a leaf may hold.
    """
    with scratch(docs.sparkSession) as keep:
        return _kd_shard(docs, leaves, target_bytes, keep)


def _kd_shard(docs: DataFrame, leaves: int | None, target_bytes: int | None, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    meta = save(metadata(docs), "meta")
    if leaves is None:
        leaves = max(1, -(-meta.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // int(target_bytes or 1 << 30)))
    table = kd_leaves(meta, leaves)
    placed = keep(number(keep(table).withColumnRenamed("node", "shard")))
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), leaves=16)


def _level(source: str, k: int) -> str:
    """One round of splits in SQL, for 16 leaves: every node of k leaves becomes two of k / 2."""
    return f"""n{k} as (
  select node, sum(size) as total, log2(max(length)::double / min(length)) / 16 as wl, (max(lang) - min(lang)) / 4294967296.0::double as wg, (max(density) - min(density)) / 3000.0::double as wd
  from {source} group by node
), c{k} as (
  select {source}.*, total, case when wl >= wg and wl >= wd then length when wg >= wd then lang else density end as coord from {source} join n{k} using (node)
), o{k} as (
  select *, coalesce(sum(size) over (partition by node order by coord, crc, doc_id nulls first, row rows between unbounded preceding and 1 preceding), 0) as before_ from c{k}
), l{k} as (
  select doc_id, size, crc, row, length, lang, density, node + case when (2 * before_ + size) * {k} <= 2 * total * {k // 2} then 0 else {k // 2} end as node from o{k}
)"""


OP3_SQL = f"""
with t as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as tab
), b as (
  select doc_id, lang as lang_text, text, octet_length(encode(coalesce(text, ''))) + 1 as size, hex(encode(coalesce(text, ''))) as h, hex(encode(coalesce(lang, ''))) as g, row_number() over () as row from documents
), y as (
  select *, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) as hs, list_transform(range(0, len(g) // 2), lambda i: ('0x' || substr(g, 2 * i + 1, 2))::bigint) as gs from b
), r as (
  select doc_id, row, size::bigint as size, length(coalesce(text, '')) as chars,
         xor(list_reduce(list_prepend(4294967295, hs), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8)), 4294967295) as crc,
         xor(list_reduce(list_prepend(4294967295, gs), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8)), 4294967295) as lang
  from y, t
), l32 as (
  select doc_id, size, crc, row, least(size, 4294967295) as length, lang, size * 1000 // (chars + 1) as density, 0 as node from r
), {_level("l32", 16)}, {_level("l16", 8)}, {_level("l8", 4)}, {_level("l4", 2)}
select doc_id, size, crc as text_crc32, 'bytes' as law, node::int as shard, (row_number() over (partition by node order by doc_id nulls first, crc, row) - 1)::bigint as slot, null::int as grown_shard
from l2
"""
