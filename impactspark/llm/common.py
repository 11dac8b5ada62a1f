"""What the training-data operators share: byte-level words, scratch tables, linked components.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactspark.session import scratch_dir, ship

#: A word is a maximal run of bytes outside this set; UTF-8 never uses them inside a character.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: The same class for the JVM: Java's \S is [^ \t\n\x0B\f\r] unless Unicode classes are asked for.
WORD = r"\S+"

#: Bytes hashed at once; a longer text goes through in several steps of this size.
CHUNK = 1 << 18

_RNG = np.random.default_rng(20240229)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, CHUNK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def _chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, np.uint8)
    n = len(buf)
    gap = np.ones(n + 2, np.int8)
    gap[1:-1] = _IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(gap))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _POW[:n], out=total[1:])
    h = (total[end] - total[start]) * _INV[start]
    # a word's length tells apart what differs only in bytes that the table maps alike
    return mix64(h + (end - start).astype(np.uint64)), start, end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a UTF-8 text, with their byte offsets.

    Equal words have equal hashes in every process. A text of any length is taken in steps that end at a
    space, so memory follows the number of words; a word beyond CHUNK bytes is hashed on its own.
    """
    n = len(data)
    if n <= CHUNK:
        return _chunk(data)
    parts, at = [], 0
    while at < n:
        cut = min(at + CHUNK, n)
        if cut < n:
            low = max(data.rfind(bytes([b]), at, cut) for b in SPACE_BYTES)
            if low > at:
                cut = low
            elif data[at] in SPACE_BYTES:
                cut = at + 1
            else:
                nxt = [p for b in SPACE_BYTES if (p := data.find(bytes([b]), at)) >= 0]
                cut = min(nxt, default=n)
                if cut - at <= CHUNK:
                    h, s, e = _chunk(data[at:cut])
                    parts.append((h, s + at, e + at))
                    at = cut
                    continue
                h = np.uint64(0)
                for k in range(at, cut, CHUNK):
                    piece = np.frombuffer(data[k : min(k + CHUNK, cut)], np.uint8)
                    with np.errstate(over="ignore"):
                        h = h * np.uint64(_BASE) + (_TABLE[piece] * _POW[: len(piece)]).sum(dtype=np.uint64)
                parts.append((mix64(np.array([h], np.uint64)), np.array([at]), np.array([cut])))
                at = cut
                continue
        h, s, e = _chunk(data[at:cut])
        parts.append((h, s + at, e + at))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def grams(h: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, salt, np.uint64)
    k = np.uint64(0x9FB21C651E98DF25)
    for j in range(n):
        out *= k
        out += h[j : j + m]
    return mix64(out)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def set_batches(spark: SparkSession) -> None:
    """The package on every worker, and Arrow batches small enough that a batch of long texts fits one many times over."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that save() writes in this scope go when it ends, but for those passed to what it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        paths = {k._scratch_path for k in kept if hasattr(k, "_scratch_path")}  # type: ignore[attr-defined]
        for df in made:
            if df._scratch_path not in paths:  # type: ignore[attr-defined]
                drop_table(spark, df)
            elif _SCOPES:
                _SCOPES[-1].append(df)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete what save() wrote for df; nothing may read it afterwards."""
    path = getattr(df, "_scratch_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    It cuts the lineage, so a lost executor costs the tasks since the last table only, and the shuffle files
    of the job that wrote it go as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, label), label the smallest node reached.

    Every round hooks each root to its smallest neighbour, halves the paths until they are flat, and contracts
    the edges, so a chain of n nodes takes about log n rounds. All of it is joins and minima over tables.
    """
    spark = edges.sparkSession
    with scratch(spark) as keep:
        return keep(_components(spark, edges))


def _components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    rest = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "hook")
        while True:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("top"))
            jumped = save(parent.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            drop_table(spark, parent)
            parent = jumped
            if not moved:
                break
        flat = parent.select("node", "label")
        if labels is None:
            labels = save(flat, "labels")
        else:
            up = flat.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = save(labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        a = flat.select(F.col("node").alias("a"), F.col("label").alias("ra"))
        b = flat.select(F.col("node").alias("b"), F.col("label").alias("rb"))
        new = save(rest.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop_table(spark, rest)
        rest = new
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels


def prefix_sums(df: DataFrame, group: list[str], order: list[str], bucket: str, weight: str, out: str) -> DataFrame:
    """Add `out`, the sum of `weight` over the rows before this one in its group, in the order given.

    `bucket` is an integer column that rises with the first order column. Sums by (group, bucket) are small and
    are added up first; rows are then sorted only within their bucket. No group ever meets in one task.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.sum(weight).alias("_w"))
    before = W.partitionBy(*[f"_{c}" for c in group]).orderBy(f"_{bucket}").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("_w").over(before), F.lit(0))).drop("_w")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(sums, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*[f"_{c}" for c in keys])
    return joined.withColumn(out, F.col("_off") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("_off")


def running(df: DataFrame, order: list[Column], sums: dict[str, str], position: str) -> DataFrame:
    """df as a table sorted by `order`, with each row's place from 1 and, for out: column in `sums`, the sum over the rows before it.

    Rows are sorted in ranges, each range is summed on its own, and only a row per range meets in one task. The order
    should be of unique rows, so that ranges can be cut anywhere.
    """
    table = save(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "running")
    total = table.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum{i}") for i, c in enumerate(sums.values())))
    before = W.orderBy("_range0").rowsBetween(W.unboundedPreceding, -1)
    total = total.withColumnRenamed("_range", "_range0")
    total = total.select("_range0", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in total.columns[1:]))
    inside = W.partitionBy("_range").orderBy(*order)
    out = table.join(F.broadcast(total), F.col("_range") == F.col("_range0")).withColumn(position, F.row_number().over(inside) + F.col("_n0"))
    for i, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.coalesce(F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col(f"_sum{i}0"))
    return _like(out.select(*df.columns, position, *sums), table)


def _like(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which reads the written table: to keep one is to keep the other."""
    df._scratch_path = table._scratch_path  # type: ignore[attr-defined]
    return df


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded number of text bytes, so that one batch of long texts never piles up."""
    for b in batches:
        step = max(1, int(b.num_rows * (4 << 20) / max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
