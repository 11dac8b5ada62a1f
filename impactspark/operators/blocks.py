"""A second layout of postings for batches of queries: by blocks of documents.

Postings by term serve single queries, which read only their terms. A batch of many queries reads most terms anyway, and
sums by (query, document) would shuffle a row for each document that any query touches. Here a row holds all
postings of BLOCK documents, so a task scores its documents against all queries on its own and hands on k rows a
query. The arithmetic is a scatter-add over arrays that fit the cache, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a block.
BLOCK = 2_048
#: Bytes of a file of blocks, about.
FILE_BYTES = 64 << 20
BLOCKS = "block long, terms array<int>, sizes array<int>, docs array<smallint>, ws array<{w}>"


def blocks_schema(mode: str) -> str:
    return BLOCKS.format(w="smallint" if mode == "u8" else "float")


#: Postings that a task takes together before it hands them on.
CHUNK = 1 << 21


def block_postings(postings: DataFrame, parts: int) -> DataFrame:
    """A row for each block of documents: its terms in order, how many postings each has, their places and weights.

    A task packs what it reads into arrays, some for each block, which alone are shuffled and then merged.
    """
    small = dict(postings.dtypes)["w"] != "float"
    kind = np.dtype(np.int16 if small else np.float32)
    one = pa.int16() if small else pa.float32()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            term, first, w = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
            held.clear()
            first = first - 1
            block = first // BLOCK
            order = np.argsort(block, kind="stable")
            block, term, d, w = block[order], term[order].astype(np.int32), (first % BLOCK).astype(np.int16)[order], w[order].astype(kind)
            cuts = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)).tolist(), len(block)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (term, d, w))], ["block", "t", "d", "w"])

        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield emit()
                n = 0
        if held:
            yield emit()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def emit() -> pa.RecordBatch:
            term, d, w = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate((np.int32, np.int16, kind)))
            held.clear()
            order = np.lexsort((d, term))
            terms, sizes = np.unique(term, return_counts=True)
            whole = [(terms, pa.int32()), (sizes.astype(np.int32), pa.int32()), (d[order], pa.int16()), (w[order], one)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in whole]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists], ["block", "terms", "sizes", "docs", "ws"])

        for b in batches:
            for r in range(b.num_rows):
                block = b.column(0)[r].as_py()
                if held and block != at:
                    yield emit()
                at = block
                held.append([b.column(i)[r].as_py() for i in (1, 2, 3)])
        if held:
            yield emit()

    packed = postings.select("term", "doc_id", "w").mapInArrow(pack, "block long, t binary, d binary, w binary")
    return packed.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(merge, blocks_schema("u8" if small else "f32"))


def files_for(rows: int, blocks: int, cores: int) -> int:
    """How many files a table of so many postings in so many blocks gets."""
    return max(1, min(blocks, max(cores, -(-4 * rows // FILE_BYTES))))


#: Hits that a task holds before it hands on what it has.
HELD = 1 << 20


def _cut(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (score desc, id asc)."""
    if len(ids) > k:
        least = -np.partition(-score, k - 1)[k - 1]
        keep = score >= least
        ids, score = ids[keep], score[keep]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def block_tops(blocks: DataFrame, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, divisor: float) -> DataFrame:
    """(q, rowid, score): for each query the k best documents of what a task reads, by (score desc, id asc), scores above 0.

    Query q has terms[starts[q]:starts[q + 1]], each once, with their weights. blocks has a column `gone`, the places of
    its deleted documents. A task that holds very many hits hands them on in several parts.
    """

    def emit(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        best = [(q, *_cut(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)) for q, parts in held.items()]
        held.clear()
        q = np.repeat([x[0] for x in best], [len(x[1]) for x in best]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[2] for x in best]) / divisor)], ["q", "rowid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.zeros(BLOCK)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0
        for b in batches:
            for r in range(b.num_rows):
                first = b.column(0)[r].as_py() * BLOCK + 1
                have, sizes, docs, ws = (b.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(1, 5))
                gone = b.column(5)[r].values
                gone = None if gone is None else gone.to_numpy(zero_copy_only=False).astype(np.intp)
                docs, ws = docs.astype(np.intp), ws.astype(np.float64)
                ends = np.cumsum(sizes)
                at = np.searchsorted(have, terms)
                at[at == len(have)] = 0
                hit = np.flatnonzero(have[at] == terms) if len(have) else np.empty(0, np.intp)
                at = at[hit]
                lists = list(zip((ends[at] - sizes[at]).tolist(), ends[at].tolist(), weights[hit].tolist(), strict=True))
                begin = np.searchsorted(hit, starts).tolist()
                for q in range(len(starts) - 1):
                    if begin[q] == begin[q + 1]:
                        continue
                    score[:] = 0
                    for low, high, w in lists[begin[q] : begin[q + 1]]:
                        score[docs[low:high]] += w * ws[low:high]
                    if gone is not None:
                        score[gone] = 0
                    found = np.flatnonzero(score > 0)
                    if len(found):
                        best = _cut(found, score[found], k)
                        held.setdefault(q, []).append((best[0] + first, best[1]))
                        n += len(best[0])
                if n > HELD:
                    yield emit(held)
                    n = 0
        if held:
            yield emit(held)

    return blocks.select("block", "terms", "sizes", "docs", "ws", "gone").mapInArrow(run, "q int, rowid long, score double")
