"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents become words: letters A-Z lower-cased, ASCII punctuation taken as space. An item of m
words may be hidden behind e = m // BUDGET edits of words. Cut into e + 1 pieces, at least one piece of it must
then stand unchanged in the document; pieces are found as hashed word runs. Every hit fixes where the item would
lie, and Myers' bit-parallel distance over that stretch decides.

Items go to the workers in blocks of at most BLOCK_BYTES. A benchmark of one block is matched in the pass that gives the
result. Of a larger one every block is a pass over the documents of its own, whose hits are written under a digest of the
text; the driver and the workers hold one block at a time, and the hits are joined to the documents at the end.

Nulls and texts without words match nothing, on either side. Items that repeat are reported under each id.
Empty tables on either side leave all documents kept. Rows that repeat are judged alike. Of documents only
doc_id and text are read, of benchmark item_id and text; texts are taken whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm.common import grams, save, scratch, set_batches, utf8, word_hashes

#: One edited word in so many is forgiven.
BUDGET = 5
BLOCK_BYTES = 8 << 20
#: Of more texts with hits than this, hits are joined by shuffle.
MAX_BROADCAST = 50_000
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(t: bytes | None) -> np.ndarray:
    return word_hashes(t.translate(_PLAIN))[0] if t else np.empty(0, np.uint64)


class Pieces:
    """The pieces of a block of items, by length."""

    def __init__(self, items: list[tuple[int, bytes]], budget: int = BUDGET):
        self.items: list[tuple[int, list[int], int]] = []
        by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            h = plain_words(text)
            m = len(h)
            if not m:
                continue
            e = m // budget
            at = len(self.items)
            self.items.append((item_id, h.tolist(), e))
            cuts = [i * m // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                by_length[b - a].append((int(grams(h[a:b], b - a)[0]), at, a))
        self.tables = []
        for n, rows in sorted(by_length.items()):
            rows.sort()
            self.tables.append((n, np.array([r[0] for r in rows], np.uint64), [r[1:] for r in rows]))

    def matches(self, t: bytes | None) -> list[tuple[int, int]]:
        """(item id, least distance) of the items that a text holds within their budget, by item id."""
        h = plain_words(t)
        where: dict[int, list[int]] = defaultdict(list)
        for n, keys, owners in self.tables:
            if len(h) < n:
                continue
            g = grams(h, n)
            low = np.searchsorted(keys, g)
            low[low == len(keys)] = 0
            for p in np.flatnonzero(keys[low] == g).tolist():
                k = int(low[p])
                while k < len(keys) and keys[k] == g[p]:
                    item, offset = owners[k]
                    where[item].append(p - offset)
                    k += 1
        out: dict[int, int] = {}
        for item, starts in where.items():
            item_id, pattern, e = self.items[item]
            best = e + 1
            for a, b in _stretches(sorted(set(starts)), len(pattern), e, len(h)):
                best = min(best, distance(pattern, h[a:b].tolist()))
                if not best:
                    break
            if best <= e:
                out[item_id] = min(best, out.get(item_id, best))
        return sorted(out.items())


def _stretches(starts: list[int], m: int, e: int, n: int) -> list[tuple[int, int]]:
    """Where an item may lie, with room for its edits; those that overlap become one."""
    out: list[tuple[int, int]] = []
    for s in starts:
        a, b = max(0, s - e), min(n, s + m + e)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def distance(pattern: list[int], text: list[int]) -> int:
    """Least edit distance between the pattern and any stretch of the text (Myers 1999, bit vectors of any length)."""
    m = len(pattern)
    eq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        eq[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        x = eq.get(w, 0)
        v = x | mv
        d = (((x & pv) + pv) ^ pv) | x
        ph = (mv | ~(d | pv)) & full
        mh = pv & d
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = (mh | ~(v | ph)) & full
        mv = ph & v
        if score < best:
            best = score
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block: list[tuple[int, bytes]] = []
    held = 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, text in rows.toLocalIterator():
        data = text.encode()
        # every word gives a bit of the pattern and, with its piece, some tens of bytes
        if block and held + 8 * len(data) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((item_id, data))
        held += 8 * len(data)
    if block:
        yield block


MATCHES = "array<struct<item:long,distance:long>>"
_MATCHES = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int64())]))


def _matcher(pieces: Pieces):
    def match(texts: pa.Array) -> pa.Array:
        return pa.array([[{"item": i, "distance": d} for i, d in pieces.matches(t)] for t in utf8(texts)], _MATCHES)

    match.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return match


def _hits(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(digest, item, distance) of all texts that hold an item of a block; equal texts count once."""
    text = F.col("text").cast("string")
    found = docs.select(F.md5(text.cast("binary")).alias("digest"), F.arrow_udf(_matcher(pieces), MATCHES)(text).alias("m"))
    return save(found.select("digest", F.inline("m")).distinct(), "hits")


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc, leaks): every row of docs as a struct, with the items that its text holds, by id, and their distances."""
    spark = docs.sparkSession
    set_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    text, none = F.col("doc.text").cast("string"), F.array().cast(MATCHES)
    with scratch(spark) as keep:
        blocks = _blocks(benchmark)
        first = next(blocks, None)
        if first is None:
            return rows.withColumn("leaks", none)
        second = next(blocks, None)
        if second is None:
            return rows.withColumn("leaks", F.arrow_udf(_matcher(Pieces(first, budget)), MATCHES)(text))
        hits = []
        for block in chain((first, second), blocks):
            hits.append(_hits(docs, Pieces(block, budget)))
        # an id may stand in several blocks
        every = spark.read.schema(hits[0].schema).parquet(*(h._scratch_path for h in hits))  # type: ignore[attr-defined]
        best = every.groupBy("digest", "item").agg(F.min("distance").alias("distance"))
        found = keep(save(best.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("item", "distance"))).alias("leaks")), "leaks"))
    few = found.count() <= MAX_BROADCAST
    rows = rows.join(F.broadcast(found) if few else found, F.md5(text.cast("binary")) == F.col("digest"), "left")
    return rows.select("doc", F.coalesce("leaks", none).alias("leaks"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of docs that hold no item."""
    return find_leaks(docs, benchmark, budget).where(F.size("leaks") == 0).select("doc.*")


def contamination(docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_items, item_ids, distances, contaminated and kept of every row of docs."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, budget)
    n = F.size("leaks")
    return found.select(
        "doc.doc_id",
        n.cast("long").alias("n_items"),
        F.col("leaks.item").alias("item_ids"),
        F.col("leaks.distance").alias("distances"),
        (n > 0).alias("contaminated"),
        (n == 0).alias("kept"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
