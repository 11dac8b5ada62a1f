"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct 5-word shingles (words lower-cased in A-Z; the whole sequence is one shingle
where there are fewer words). Two permutations of the 32-bit integers make the whole signature: every shingle
goes through the first once, and coordinate k is the smallest value of the second after a circular shift by k.
Bands of the signature are buckets.

Equal sets are one class, named by a 128-bit digest, and only its smallest document goes on, so groups of
copies cost nothing further. In every bucket all classes are first held against the smallest one; components of
what is confirmed are taken, and then only pairs of classes that share a bucket and are still in different
components are held against each other. Together these decide every link between classes that share a bucket
which could join two components, without writing out the pairs within a group. All confirmations are made on
full sets. Of those pairs, the ones that cannot be similar enough by the sizes of their sets, by
how many shingles of theirs nobody else has, or by the triangle inequality of the Jaccard distance through the
bucket's smallest class, are not compared. With 24 bands of 6, a pair at similarity 0.85 shares no bucket once in 86,000 times.

No key fills a task: the text of a class that is held against many goes to as many tasks as they need, a bucket of
many classes is compared in cells of two blocks of CROWD classes each, and the names of classes that hold more than a
thousandth of all documents are broadcast, of which there are fewer than a thousand.

Nulls and empty texts: the set is empty and linked with nothing. A row with a null doc_id is linked with
nothing either and has a null component_id; it is kept. Rows that repeat a doc_id are taken as one document; where one
row of it is to stay, that is the one with the least text, and of equal texts the least in its other columns.
An empty table gives an empty result. Only doc_id and text are read. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm.common import arrow_rows, components, drop_table, grams, mix64, save, scratch, set_batches, utf8, word_hashes

SHINGLE, BANDS, ROWS = 5, 24, 6
SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_STEP = 512
#: Classes of a bucket, or partners of a class, that one task takes.
CROWD = 4_096


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes."""
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(text.lower())[0]
    if len(h) >= SHINGLE:
        return np.unique(grams(h, SHINGLE))
    return grams(h, len(h), salt=len(h) + 100) if len(h) else h


def _first(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray) -> np.ndarray:
    """The circulant MinHash signature of a set of 64-bit hashes."""
    low = _first((s >> np.uint64(32)).astype(np.uint32))
    out = np.full(len(SHIFTS), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), _STEP):
        x = low[None, k : k + _STEP] - SHIFTS
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE3D)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = h * np.uint64(0x9FB21C651E98DF25) + x[:, j]
    return mix64(h).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, keys = [], [], []
        for t in utf8(b.column(1)):
            s = shingles(t)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(bands(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, bytes, np.ndarray] | None = None
        for b in arrow_rows(batches):
            far, linked = [], []
            for a, ta, tb in zip(b.column(0).to_pylist(), utf8(b.column(2)), utf8(b.column(3)), strict=True):
                if last is None or last[0] != a or last[1] != ta:
                    last = (a, ta, shingles(ta))
                x, y = last[2], shingles(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                far.append(1 - both / union if union else 1.0)
                linked.append(both > 0 and 100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "distance", "linked"])

    return run


def compare(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, crowd) with the Jaccard distance of their full sets, and whether that links them.

    crowd: how many pairs may have this a; it is sent to a task for every CROWD of them.
    """
    pairs = pairs.groupBy("a", "b").agg(F.max("crowd").alias("crowd"))
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("crowd") / CROWD)).alias("task"))
    a = pairs.select("a", "task").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    # merge joins at every size, so that a plan measured on little data is the plan on much
    full = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), ["a", "task"]).select("a", "b", "ta", "tb")
    out = full.mapInArrow(_compare(percent), "a long, b long, distance double, linked boolean")
    return save(out.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.max("linked").alias("linked")), "compared")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow_rows(batches):
        sets = [shingles(t) for t in utf8(b.column(1))]
        rep = np.repeat(b.column(0).to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], ["rep", "shingle"])


def lone_shingles(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, lone): how many shingles of each document no other document of reps(rep) has."""
    own = texts.join(reps.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = own.select("doc_id", "text").mapInArrow(_explode, "rep long, shingle long")
    return rows.groupBy("shingle").agg(F.min("rep").alias("rep"), F.count("*").alias("n")).where("n = 1").groupBy("rep").agg(F.count("*").alias("lone"))


def mixed(held: DataFrame) -> DataFrame:
    """The rows whose bucket holds more than one label."""
    ends = held.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    return held.join(ends, "band")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    set_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return _near_duplicates(docs, percent, keep)


def _near_duplicates(docs: DataFrame, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(save(docs.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed"))
    real = signed.where("digest is not null and doc_id is not null")
    classes = save(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")

    slots = classes.select("rep", "n", F.explode("bands").alias("band"))
    crowd = slots.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("crowd")).where("crowd > 1")
    buckets = save(slots.join(crowd, "band").select("band", "rep", "n", "pivot", "crowd"), "buckets")
    star = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "crowd")
    # the only time that texts are shuffled: those of classes that share a bucket, for all comparisons
    texts = save(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    star = compare(star, texts, percent)
    links = star.where("linked").select("a", "b")
    labels = components(links)

    # what may still join two components: pairs of one bucket with different labels, unless bounds rule them out
    label = labels.select(F.col("node").alias("rep"), F.col("label"))
    held = buckets.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    far = star.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "distance")
    held = mixed(held).join(far, ["pivot", "rep"], "left").select("band", "rep", "n", "label", F.coalesce("distance", F.lit(0.0)).alias("d"))
    held = save(held, "held")
    lone = save(lone_shingles(held.select("rep").distinct(), texts), "lone")
    # the shingles that another set can share at most; too few for any partner, and the class is out
    held = held.join(lone, "rep", "left").withColumn("share", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    held = save(mixed(held.where(100 * F.col("share") >= percent * F.col("n"))), "open")
    # every pair of blocks of a bucket is a cell of its own: the first block stands left, the second right
    size = held.groupBy("band").agg(F.count("*").alias("crowd"))
    held = held.join(size, "band").withColumn("blocks", F.ceil(F.col("crowd") / CROWD).cast("int"))
    held = held.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    left = held.withColumn("cell", F.col("block")).withColumn("cell2", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = held.withColumn("cell2", F.col("block")).withColumn("cell", F.explode(F.sequence(F.lit(0), "block")))
    right = right.select("band", "cell", "cell2", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "label", "d", "share")))
    most = F.least("share", "share2")
    may = (100 * most >= percent * (F.col("n") + F.col("n2") - most)) & (F.abs(F.col("d") - F.col("d2")) <= 1 - percent / 100 + 1e-9)
    once = (F.col("cell") < F.col("cell2")) | (F.col("rep") < F.col("rep2"))
    apart = left.join(right, ["band", "cell", "cell2"]).where(once & (F.col("label") != F.col("label2")) & (F.col("d") > 0) & (F.col("d2") > 0) & may)
    rest = apart.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"), "crowd")
    rest = save(rest.groupBy("a", "b").agg(F.max("crowd").alias("crowd")).join(star, ["a", "b"], "left_anti"), "apart")
    if not rest.isEmpty():
        more = compare(rest, texts, percent).where("linked").select("a", "b")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    drop_table(spark, texts)

    label = labels.select(F.col("node").alias("rep"), "label")
    named = keep(save(classes.select("digest", "rep", "copies").join(label, "rep", "left").select("digest", "copies", F.coalesce("label", "rep").alias("component")), "named"))
    # large classes by broadcast; rows of these and of no class are spread by a key that no class has
    large = F.col("copies") * 1000 > signed.count()
    top = named.where(large).select("digest", F.col("component").alias("top"))
    out = signed.select("doc_id", "n_shingles", "digest").join(F.broadcast(top), "digest", "left")
    alone = F.concat(F.lit("no class "), F.coalesce("doc_id", F.lit(0)).cast("string")).cast("binary")
    key = F.when(F.col("top").isNotNull() | F.col("digest").isNull(), alone).otherwise(F.col("digest"))
    out = out.withColumn("digest", key).join(named.where(~large).select("digest", "component"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs without all but one document of each component; of rows that repeat an id, one stays."""
    with scratch(docs.sparkSession) as keep:
        verdict = save(near_duplicates(docs, percent), "verdict")
        gone = keep(save(verdict.where(~F.col("kept")).select("doc_id").distinct(), "gone"))
        twice = keep(save(verdict.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice"))
    rest = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return rest
    whole, order = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    once = rest.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct(F.col("text"), *(F.col(f"`{c}`") for c in order))).alias("row")).select("row.*")
    return rest.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), g as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
         else list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) end as s
  from w
), n as (select doc_id, len(s) as n from g),
c as (select doc_id, hash(list_sort(s)) as c, len(s) as n from g where len(s) > 0),
r as (select c, min(doc_id) as rep, any_value(n) as n from c group by c),
x as (select doc_id as rep, unnest(s) as sh from g where doc_id in (select rep from r)),
p as (select a.rep as a, b.rep as b, count(*) as common from x a join x b on a.sh = b.sh and a.rep < b.rep group by all),
e as (select a, b from p join r ra on ra.rep = p.a join r rb on rb.rep = p.b where 100 * common >= 85 * (ra.n + rb.n - common)),
s as (select a, b from e union all select b, a from e),
t(node, reach) as (select rep, rep from r union select t.node, s.b from t join s on s.a = t.reach),
l as (select node, min(reach) as label from t group by node)
select n.doc_id, n.n::bigint as n_shingles, coalesce(l.label, n.doc_id) as component_id, coalesce(l.label, n.doc_id) = n.doc_id as kept
from n left join c on c.doc_id = n.doc_id left join r on r.c = c.c left join l on l.node = r.rep
"""
