"""Substring deduplication by recompression.

Rounds of recompression give text positions global names. A name is a 64-bit fingerprint of what it stands for,
so equal runs and equal pairs get equal names on every executor without exchanging a dictionary. Each round
names maximal runs of one symbol, then splits the alphabet in two by a bit of the name and names every pair
of a left symbol and a right one. Whether a symbol of the second round starts at a word, and its name, follow from five
words to each side where no two neighbours among these are equal; else its start does, and the name of the symbol of
the first round that it begins with. So inside equal passages the same symbols stand at the same places.

A third round names every symbol in its context: the name just said, with the ten words that it follows from. A window of
20 words holds symbols of which all that lies within it, so all its copies share them, whatever surrounds them; the one
with the smallest name stands for the window. These names are what a Spark shuffle brings together: one that occurs once
cannot belong to a repeat, and one that occurs again reveals the windows that it stands for. Those are verified: they are
compared by a 128-bit fingerprint of all
their 20 words, in order of (document, start), and every one but the first is covered. Windows in which one word
comes three times in a row, where runs may leave the window, skip the names and are verified directly.
So every repeated window is found, and only those.

Tasks combine before they shuffle: of equal names or windows in a task one goes on, the others are decided there and
only spread evenly. Documents with equal words are one class first; all but the smallest id are covered whole, so large groups of
copies never meet in a task.

Nulls: a null text has no words, and a null doc_id orders before all others. Rows that repeat a doc_id are one
document and get one result; should their texts differ, what is covered in one is covered in all.
An empty table gives an empty result. Only doc_id and text are read; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm.common import arrow_rows, drop_table, grams, mix64, partitions, save, scratch, set_batches, utf8, word_hashes

WINDOW = 20
#: Words to each side that decide a boundary of the second round.
REACH = 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_K = np.uint64(0x9FB21C651E98DF25)


def _name(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), 0x51ED27, np.uint64)
    for p in parts:
        out *= _K
        out += p
    return mix64(out)


def _runs(names: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name maximal runs of one symbol."""
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    at = np.flatnonzero(first)
    length = np.diff(at, append=len(names)).astype(np.uint64)
    kept = names[at]
    return np.where(length > 1, _name(kept, length), kept), start[at]


def _pairs(names: np.ndarray, start: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name pairs of a left symbol (bit 0) and a right one (bit 1) that follow each other."""
    n = len(names)
    head = np.zeros(n, bool)
    head[:-1] = (bit[:-1] == 0) & (bit[1:] == 1)
    tail = np.zeros(n, bool)
    tail[1:] = head[:-1]
    out = names.copy()
    h = np.flatnonzero(head)
    out[h] = _name(names[h], names[h + 1])
    return out[~tail], start[~tail]


def recompress(h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The symbols of the first and of the second round, each with the words at which they start."""
    names, start = _runs(h, np.arange(len(h)))
    # the word itself gives the side in the first round, so a run that leaves a window doesn't change it
    names, start = _pairs(names, start, (h[start] & np.uint64(1)).astype(np.int8))
    return (names, start), _pairs(names, start, ((names >> np.uint64(7)) & np.uint64(1)).astype(np.int8))


def symbols(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) of the third round: symbols of the second in the context of the ten words that fix them."""
    (low, low_start), (names, start) = recompress(h)
    inside = (start >= REACH) & (start + REACH <= len(h))
    names, start = names[inside], start[inside]
    # where neighbours are equal a run may leave the context, and a symbol of the second round with it
    same = np.concatenate([[0], np.cumsum(h[1:] == h[:-1])])
    calm = same[start + REACH - 1] == same[start - REACH]
    names = np.where(calm, names, low[np.searchsorted(low_start, start)])
    return _name(names, grams(h, 2 * REACH, salt=7)[start - REACH]), start


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, places): a name for each chosen place; and the place for each window, -1 where it is to be verified directly."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    value = np.full(len(h) + 1, _NONE, np.uint64)
    names, start = symbols(h)
    value[start] = names
    # the smallest value in [p + REACH, p + WINDOW - REACH], the first of equals
    first = value[REACH : REACH + n].copy()
    place = np.arange(REACH, REACH + n)
    for j in range(1, WINDOW - 2 * REACH + 1):
        v = value[REACH + j : REACH + j + n]
        less = v < first
        first[less] = v[less]
        place[less] = np.flatnonzero(less) + REACH + j
    triple = np.concatenate([[0], np.cumsum((h[:-2] == h[1:-1]) & (h[1:-1] == h[2:]))])
    direct = (triple[WINDOW - 2 : WINDOW - 2 + n] > triple[:n]) | (first == _NONE)
    place[direct] = -1
    chosen = np.unique(place[~direct])
    return value[chosen], chosen, place


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, keys, places, direct = [], [], [], [], []
        for t in utf8(b.column(1)):
            h = word_hashes(t)[0] if t else np.empty(0, np.uint64)
            name, at, place = anchors(h)
            n.append(len(h))
            digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            keys.append(name.view(np.int64))
            places.append(at.astype(np.int32))
            direct.append(bool((place < 0).any()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(direct, pa.bool_())],
            ["doc_id", "n_words", "digest", "keys", "places", "direct"],
        )


#: Rows that a task holds to combine before they are shuffled.
FLUSH = 1 << 20
ALONE, SEVERAL, KNOWN = 0, 1, 2


def _same(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row but the first equals the one before it."""
    eq = np.ones(t.num_rows - 1, bool)
    for k in columns:
        c = t.column(k).to_numpy()
        eq &= c[1:] == c[:-1]
    return eq


def _states(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For rows in order, whether each is alone, the first of several, or a later one whose fate is known already."""
    first = np.concatenate([[True], ~same])
    return np.where(~first, KNOWN, np.where(np.concatenate([same, [False]]), SEVERAL, ALONE)).astype(np.int8)[: len(order)]


def _combine_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, keys, places) to rows (k, doc_id, place, state), combined over FLUSH names in a task."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        k, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(k, kind="stable")
        k = k[order]
        state = _states(order, k[1:] == k[:-1])
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(doc[order]), pa.array(place[order]), pa.array(state)], ["k", "doc_id", "place", "state"])

    n = 0
    for b in arrow_rows(batches):
        doc = b.column(0).to_numpy()
        k, place = b.column(1), b.column(2)
        if not len(k.flatten()):
            continue
        length = np.diff(k.offsets.to_numpy())
        held.append((k.flatten().to_numpy(), np.repeat(doc, length), place.flatten().to_numpy()))
        n += len(held[-1][0])
        if n >= FLUSH:
            yield flush()
            n = 0
    if held:
        yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, doc_id, place, state) sorted by k, those whose k stands elsewhere too. One row is held back."""
    held: pa.Table | None = None
    held_same = False
    for b in batches:
        t = pa.Table.from_batches([b])
        known = t.column("state").to_numpy() == KNOWN
        yield from t.filter(pa.array(known)).select(["doc_id", "place"]).to_batches()
        t = t.filter(pa.array(~known))
        if not t.num_rows:
            continue
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        eq = _same(t, ["k"])
        before = np.concatenate([[held_same], eq]) | (t.column("state").to_numpy() == SEVERAL)
        yield from t.slice(0, t.num_rows - 1).filter(pa.array(before[:-1] | eq)).select(["doc_id", "place"]).to_batches()
        held, held_same = t.slice(t.num_rows - 1), bool(before[-1])
    if held is not None and held_same:
        yield from held.select(["doc_id", "place"]).to_batches()


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (w1, w2, doc_id, start, state) in this order, those that are not the first place of their window.

    The last row of a batch goes on to the next one, with whether it is a first place; a place that stands twice,
    as repeated rows make it, is first both times.
    """
    held: pa.Table | None = None
    held_first = True
    for b in batches:
        t = pa.Table.from_batches([b])
        known = t.column("state").to_numpy() == KNOWN
        yield from t.filter(pa.array(known)).select(["doc_id", "start"]).to_batches()
        t = t.filter(pa.array(~known))
        if not t.num_rows:
            continue
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        n = t.num_rows
        window, place = _same(t, ["w1", "w2"]), _same(t, ["w1", "w2", "doc_id", "start"])
        begins = np.concatenate([[True], ~window])
        steps = np.concatenate([[0], np.cumsum(~place)])
        at = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        first = steps == steps[at]
        if held is not None and not held_first:
            first[at == 0] = False
        later = ~first
        if held is not None:
            later[0] = False  # decided in its own batch
        yield from t.filter(pa.array(later)).select(["doc_id", "start"]).to_batches()
        held, held_first = t.slice(n - 1), bool(first[-1])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the windows to verify: (doc_id, places, text) to (w1, w2, doc_id, start, state).

    Of equal windows in a task the first place goes on as a candidate; the others are later than it whatever other
    tasks hold, which makes them known.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        w1, w2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((start, doc, w2, w1))
        w1, w2, doc, start = w1[order], w2[order], doc[order], start[order]
        same = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
        state = _states(order, same)
        # a place that stands twice is not later than itself
        again = same & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
        for i in np.flatnonzero(again):
            if state[i] != KNOWN:
                state[i + 1] = SEVERAL
        return pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(doc), pa.array(start), pa.array(state)], ["w1", "w2", "doc_id", "start", "state"])

    n = 0
    for b in arrow_rows(batches):
        for doc, found, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
            h = word_hashes(t)[0]
            place = anchors(h)[2]
            known = np.zeros(len(h) + 2, bool)
            known[np.array(found or [], np.int64)] = True
            known[-1] = True  # place -1: verified directly
            at = np.flatnonzero(known[place])
            if not len(at):
                continue
            w1, w2 = grams(h, WINDOW, 3)[at].view(np.int64), grams(h[::-1].copy(), WINDOW, 5)[::-1][at].view(np.int64)
            held.append((w1, w2, np.full(len(at), doc, np.int64), at.astype(np.int32)))
            n += len(at)
            if n >= FLUSH:
                yield flush()
                n = 0
    if held:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow_rows(batches):
        n, gone, sha, kept = [], [], [], []
        whole = b.column(2).to_pylist()
        for starts, all_, t in zip(b.column(1), whole, utf8(b.column(3)), strict=True):
            _, s, e = word_hashes(t) if t else (None, np.empty(0, np.int64), np.empty(0, np.int64))
            m = len(s)
            if all_ and m >= WINDOW:
                left, removed = b"", m
            elif starts.is_valid and len(starts.values):
                step = np.zeros(m + 1, np.int64)
                p = np.unique(starts.values.to_numpy())
                p = p[p + WINDOW <= m]
                np.add.at(step, p, 1)
                np.add.at(step, p + WINDOW, -1)
                stay = np.cumsum(step[:m]) == 0
                left, removed = b" ".join([t[i:j] for i, j in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]), int(m - stay.sum())
            else:
                left, removed = b" ".join(t.split()) if t else b"", 0
            n.append(m)
            gone.append(removed)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row of docs."""
    set_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return _remove_repeats(docs, keep)


def _remove_repeats(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    p = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low = F.coalesce("doc_id", F.lit(-(2**63)))
    survey = save(docs.mapInArrow(_survey, "doc_id long, n_words long, digest binary, keys array<long>, places array<int>, direct boolean").where(f"n_words >= {WINDOW}"), "survey")
    reps = survey.groupBy("digest").agg(F.min(low).alias("rep"))
    copies = save(survey.select("doc_id", "digest").join(reps, "digest").where(low != F.col("rep")).select(low.alias("copy")).distinct(), "copies")
    first = survey.withColumn("doc_id", low).join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    # what is known needs no company: it is spread by its place, so that no name or window fills a task
    known = F.col("state") == KNOWN
    names = first.select("doc_id", "keys", "places").mapInArrow(_combine_names, "k long, doc_id long, place int, state byte")
    names = names.repartition(p, F.when(known, F.xxhash64("doc_id", "place")).otherwise(F.col("k"))).sortWithinPartitions("k")
    shared = names.mapInArrow(_shared, "doc_id long, place int")
    shared = save(shared, "shared")
    found = shared.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    marked = first.where("direct").select("doc_id").distinct()
    todo = save(found.join(marked, "doc_id", "full"), "todo")
    drop_table(spark, survey)
    drop_table(spark, shared)

    keyed = docs.where("text is not null").withColumn("doc_id", low)
    candidates = keyed.join(todo, "doc_id").select("doc_id", "places", "text").mapInArrow(_windows, "w1 long, w2 long, doc_id long, start int, state byte")
    spread = F.when(known, F.xxhash64("doc_id", "start")).otherwise(F.col("w1"))
    candidates = candidates.repartition(p, spread).sortWithinPartitions("w1", "w2", "doc_id", "start")
    later = save(candidates.mapInArrow(_later, "doc_id long, start int"), "later")
    covered = later.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    covered = covered.join(copies.select(F.col("copy").alias("doc_id"), F.lit(True).alias("whole")), "doc_id", "full")
    covered = keep(save(covered.select(F.col("doc_id").alias("_id"), "starts", F.coalesce("whole", F.lit(False)).alias("whole")), "covered"))
    drop_table(spark, later)
    full = docs.join(covered, low == F.col("_id"), "left").select("doc_id", "starts", F.coalesce("whole", F.lit(False)).alias("whole"), "text")
    return full.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


OP4_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), x as (
  select doc_id, unnest(range(1, len(ws) - 18)) as i, ws from w where len(ws) >= 20
), h as (
  select doc_id, i, md5(array_to_string(ws[i:i+19], ' ')) as k from x
), l as (
  select doc_id, i, row_number() over (partition by k order by doc_id, i) > 1 as again from h
), c as (
  select distinct doc_id, unnest(range(i, i + 20)) as j from l where again
), t as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from w
), k as (
  select t.doc_id, string_agg(t.word, ' ' order by t.j) filter (where c.j is null) as kept, count(c.j) as gone
  from t left join c on c.doc_id = t.doc_id and c.j = t.j group by t.doc_id
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id
"""
