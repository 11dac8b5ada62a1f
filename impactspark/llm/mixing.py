"""Mixing sources to target weights by capped water-filling.

Every source has a weight and at most `max_epochs` times its own words to give. Words are shared by weight;
what a source cannot give is shared again among the others by weight, until no target is above its cap. That
loop's fixed point is one water level, found here from running sums over the sources in order of cap / weight; the
sources are sorted in ranges, so that a table of very many never meets in one task.

A target then becomes whole repetitions of each document plus a fraction: the documents that come first in a
seeded order of hashes until the fraction is met. Documents above a fortieth of their source, at most 39, come before
the others: in the seeded order, leaving out each that does not fit into what is left. Where the other documents
are too few to fill the rest, those are taken instead whose sum, with the others, comes nearest to the fraction.

Nulls: a null source is a source of its own, last in order; a null text has no words; a null id hashes as the
empty string. Empty tables give empty results. Rows that tie in the seeded order are ordered by size; those alike in
id, source and size are taken one by one too: as many of them as the fraction needs, first by a hash of the text,
rows that are the same throughout in any order. Other columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm.common import WORD, prefix_sums, running, save, scratch
from impactspark.session import ship

SEED = 17
#: A document above a fortieth of its source is placed first.
LONG = 40
#: Of sums of long documents that differ by less than this part of the goal, one is followed.
SUM_STEPS = 4096
#: A plan of more sources than this is joined by shuffle; a plan has at most 40 places of documents for a source.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """sizes(source, source_size), one row per source, with target."""
    t = running(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {}, "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = t.withColumn("_weight", F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    size, weight = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
    t = running(t, [(F.col("_cap") / F.col("_weight")).asc(), F.col("_rank").asc()], {"_given": "_cap", "_shut": "_weight"}, "_at")
    t = t.withColumn("_left", F.lit(float(size) * float(share)) - F.col("_given")).withColumn("_open", F.lit(float(weight)) - F.col("_shut"))
    t = t.withColumn("_capped", F.col("_cap") * F.col("_open") <= F.col("_weight") * F.col("_left"))
    level = t.where(~F.col("_capped")).agg(F.min(F.struct("_at", "_left", "_open")).alias("l")).first()["l"]
    target = F.col("_cap")
    if level is not None:
        target = F.when(F.col("_capped"), target).otherwise(F.col("_weight") * F.lit(level["_left"]) / F.lit(level["_open"]))
    return t.select("source", "source_size", target.alias("target"))


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))


def choose(longs: list | None, goal: float, short: int) -> list:
    """How many of a source's long documents (key, size, n alike) its fraction takes: (key, size, n, take).

    `short` words of other documents may follow.
    """
    places = sorted((x[0], x[1], x[2]) for x in longs or [])
    items = [(i, size) for i, (_, size, n) in enumerate(places) for _ in range(n)]
    given, taken = 0, []
    for i, size in items:
        if given + size <= goal:
            given += size
            taken.append(i)
    if len(taken) < len(items) and goal - given > short:
        # the short ones cannot fill the rest: the sums that long ones make, each with the documents that make it
        sums = {0: (0, 0)}
        for j, (_, size) in enumerate(items):
            for s, m in [*sums.values(), *((s + size, m + (1 << j)) for s, m in sums.values() if s <= goal)]:
                at = floor(s * SUM_STEPS / goal)
                if at not in sums or (-s, m) < (-sums[at][0], sums[at][1]):
                    sums[at] = (s, m)
        mask = min((max(goal - s - short, s - goal, 0), s, m) for s, m in sums.values())[2]
        taken = [i for j, (i, _) in enumerate(items) if mask >> j & 1]
    return [(*p, taken.count(i)) for i, p in enumerate(places) if i in taken]


def _with_source(rows: DataFrame, source: str, plan: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(plan) if few else plan, F.col(source).eqNullSafe(F.col("_source")))


def plan_mix(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int) -> DataFrame:
    """One row per source: its size, target, whole repetitions, and what its fraction takes.

    Only ids, sources and sizes are sorted; rows alike in them are counted first, so that one id never fills a task. Of
    most documents it takes a stretch from the start of the order, so the last one taken whole says it all: `short`.
    `long` lists those above 1 / LONG of the source that it takes, `part` the places of which it takes some rows only.
    """
    rows = save(docs.select("source", _key(seed).alias("key"), word_count(F.col("text")).alias("size")), "sizes")
    fill = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    fill = fill.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "_source")
    fill = save(fill, "fill")
    few = fill.count() <= MAX_BROADCAST_SOURCES
    places = rows.where("size > 0").groupBy("source", "key", "size").agg(F.count("*").alias("n"))
    places = _with_source(places, "source", fill, few).where("goal > 0").select("source", "size", "goal", "key", "n", (F.col("size") * F.col("n")).alias("words"), (F.col("size") * LONG > F.col("source_size")).alias("long"))
    places = places.withColumn("bucket", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    places = save(prefix_sums(places, ["source", "long"], ["key", "size"], "bucket", "words", "before"), "order")
    longs = places.where("long").groupBy(F.col("source").alias("_s")).agg(F.collect_list(F.struct("key", "size", "n")).alias("long"))
    rest = places.where("not long").groupBy(F.col("source").alias("_r")).agg(F.sum("words").alias("rest"))
    ship(docs.sparkSession)
    pick = F.udf(choose, "array<struct<key:string,size:bigint,n:bigint,take:bigint>>", useArrow=False)
    longs = _with_source(longs, "_s", fill.select("_source", "goal"), few).join(rest, F.col("_s").eqNullSafe(F.col("_r")), "left")
    longs = save(longs.select("_s", pick("long", "goal", F.coalesce("rest", F.lit(0))).alias("long")), "long")
    given = F.coalesce(F.aggregate("long", F.lit(0).cast("long"), lambda n, x: n + x["size"] * x["take"]), F.lit(0))
    fill = fill.join(longs, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("given", given)
    short = _with_source(places.where("not long"), "source", fill.select("_source", "given"), few)
    size, before, room = F.col("size"), F.col("before"), F.col("goal") - F.col("given")

    def fits(k: Column) -> Column:
        """Whether the k-th row of a place, from 0, is to be taken: at least half of it lies before the goal."""
        return before + k * size + size / 2 <= room

    take = F.least("n", F.greatest(F.lit(0), F.floor((room - before) / size + 0.5))).cast("long")
    take = take + F.when((take < F.col("n")) & fits(take), 1).when((take > 0) & ~fits(take - 1), -1).otherwise(0)
    short = short.withColumn("take", take).where("take > 0")
    all_ = F.when(F.col("take") == F.col("n"), F.struct("key", "size"))
    some = F.when(F.col("take") < F.col("n"), F.struct("key", "size", "take"))
    short = short.groupBy(F.col("source").alias("_s")).agg(F.max(all_).alias("short"), F.max(some).alias("some"))
    fill = fill.join(short, F.col("_source").eqNullSafe(F.col("_s")), "left")
    part = F.transform(F.filter("long", lambda x: x["take"] < x["n"]), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["take"].alias("take")))
    part = F.concat(F.coalesce(part, F.array().cast("array<struct<key:string,size:bigint,take:bigint>>")), F.array_compact(F.array("some")))
    listed = F.transform(F.filter("long", lambda x: x["take"] == x["n"]), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size")))
    return fill.select("_source", "source_size", "target", "whole", listed.alias("long"), "short", part.alias("part"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """(doc, mix): every row of docs as a struct, with its size, source_size, target, repeats and taken."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        plan = keep(save(plan_mix(docs, weights, share, max_epochs, seed), "plan"))
        few = plan.count() <= MAX_BROADCAST_SOURCES
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), word_count(F.col("text")).alias("_size"), _key(seed).alias("_at"))
        rows = rows.withColumn("_from", F.col("doc.source"))
        rows = _with_source(rows, "_from", plan, few)
        place = F.struct(F.col("_at").alias("key"), F.col("_size").alias("size"))
        listed = F.exists("long", lambda x: (x["key"] == F.col("_at")) & (x["size"] == F.col("_size")))
        fits = F.when(F.col("_size") * LONG > F.col("source_size"), listed).otherwise(place <= F.col("short"))
        # a document without words weighs nothing; it comes along with the whole repetitions only
        extra = F.coalesce((F.col("_size") > 0) & fits, F.lit(False)).cast("long")
        parts = plan.select("_source", F.explode("part").alias("p"))
        if not parts.isEmpty():
            # some rows of a place: those of such places are numbered, all others are as before
            part = F.filter("part", lambda p: (p["key"] == F.col("_at")) & (p["size"] == F.col("_size")))
            tied = rows.where(F.size(part) > 0).withColumn("_take", F.element_at(part, 1)["take"])
            tied = tied.withColumn("_h", F.xxhash64("doc.text")).withColumn("_row", F.monotonically_increasing_id())
            one = ["_from", "_at", "_size"]
            tied = keep(running(save(tied, "tied"), [F.col(c) for c in (*one, "_h", "_row")], {}, "_pos"))
            start = tied.groupBy(*[F.col(c).alias(f"{c}0") for c in one]).agg(F.min("_pos").alias("_start"))
            tied = tied.join(F.broadcast(start) if few else start, [F.col(c).eqNullSafe(F.col(f"{c}0")) for c in one])
            tied = tied.withColumn("_extra", (F.col("_pos") - F.col("_start") < F.col("_take")).cast("long"))
            rows = rows.where(F.size(part) == 0).withColumn("_extra", extra)
            rows = rows.unionByName(tied.select(*rows.columns))
        else:
            rows = rows.withColumn("_extra", extra)
    repeats = F.col("whole") + F.col("_extra")
    return rows.select("doc", F.struct(F.col("_size").alias("size"), "source_size", "target", repeats.alias("repeats"), (repeats * F.col("_size")).alias("taken")).alias("mix"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as many times as it was taken."""
    return mixed.where("mix.repeats > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("mix.repeats").cast("int")))).select("doc.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP7_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':17') as k, row_number() over () as row
  from documents
), s as (select source, sum(size)::bigint as source_size from d group by source
), r as (select *, row_number() over (order by source asc nulls last) as rk from s
), w as (select *, case (rk - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight,
                source_size * 2.0::double as cap, (sum(source_size) over ())::double * 1.5::double as total from r
), f as (select *, total - coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0) as rest,
                sum(weight) over (order by cap / weight, rk rows between current row and unbounded following) as open,
                row_number() over (order by cap / weight, rk) as pos from w
), c as (select *, cap * open <= weight * rest as capped from f
), l as (select rest as l_rest, open as l_open from c where not capped order by pos limit 1
), t as (select rk, source, source_size, case when capped then cap else weight * l_rest / l_open end as target from c left join l on true
), v as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t
), o as (select d.*, v.rk, v.source_size, v.target, v.whole, v.target - v.whole * v.source_size as goal, d.size * 40 > v.source_size as long_
         from d join v on d.source is not distinct from v.source
), i as (select rk, any_value(goal) as goal, list(size order by k, size, row) filter (long_) as xs, list(row order by k, size, row) filter (long_) as ids,
                coalesce(sum(size) filter (not long_), 0) as short from o where size > 0 and goal > 0 group by rk
), a as (select *, list_reduce(list_prepend(0::bigint, xs), lambda n, x: case when n + x <= goal then n + x else n end) as given from i where xs is not null
), e as (select *, given < list_sum(xs) and goal - given > short as search from a
), u as (
  select rk, 0 as j, 0::bigint as s, 0::bigint as m from e where search
  union all
  select rk, j, s, m from (
    select rk, j, s, m, row_number() over (partition by rk, floor(s * 4096.0::double / goal) order by s desc, m) as nth
    from (select u.rk, u.j + 1 as j, u.s + b * e.xs[u.j + 1] as s, u.m + b * (1::bigint << u.j) as m, e.goal from u join e using (rk), range(2) x(b) where u.j < len(e.xs) and (b = 0 or u.s <= e.goal))
  ) where nth = 1
), y as (
  select u.rk, u.m from u join e using (rk) where u.j = len(e.xs) qualify row_number() over (partition by u.rk order by greatest(e.goal - u.s - e.short, u.s - e.goal, 0), u.s, u.m) = 1
), z as (
  select row, xs[n] as x, case when search then (y.m >> (n - 1)) & 1 = 1
         else list_reduce(list_prepend(0::bigint, xs[1:n - 1]), lambda q, x: case when q + x <= goal then q + x else q end) + xs[n] <= goal end as fits
  from (select *, unnest(ids) as row, generate_subscripts(ids, 1) as n from e) left join y using (rk)
), p as (
  select o.*, coalesce(z.fits, false) as fits, coalesce(sum(o.size) over (partition by o.rk, o.long_ order by o.k, o.size, o.row rows between unbounded preceding and 1 preceding), 0) as before_
  from o left join z on z.row = o.row
), g as (select *, coalesce(sum(case when fits then size end) over (partition by rk), 0) as given from p)
select doc_id, size, source_size, target,
       (size * (whole + case when size > 0 and (fits or (not long_ and before_ + size / 2.0::double <= goal - given)) then 1 else 0 end))::bigint as taken
from g
"""
