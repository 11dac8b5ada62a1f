"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are held against references of every
language with the Jensen-Shannon distance (base 2, the square root of the divergence). References are counts
over all documents: characters by class, and the COMMON most frequent words of each language with all other
words as one more bin. A document fails if its nearest reference is too far in either histogram, each guarded by
a least length, below which a histogram is too thin to judge.

Base rules stand beside it: too few words, or more than half of the words in repeated three-word windows.

Nulls and empty texts have no words and fail the base rule. A document without language is held against the references
of all languages, as are those of languages that have one; it makes no reference itself. Documents of a language of less
than MIN_REFERENCE_WORDS words have no fair reference: they are judged by the base rules alone, and their distances are
null. An empty table gives an empty result. Rows that repeat are judged alike. Only doc_id, text and lang are read, texts
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactspark.llm.common import arrow_rows, grams, save, scratch, set_batches, utf8, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Common words of a language; all its other words are one more bin.
COMMON = 16
#: References that a document is held against at once; the driver and each task hold some 500 bytes for each language.
LANGUAGES_AT_ONCE = 1_024
#: A language gives a reference from this many words on.
MIN_REFERENCE_WORDS = 2_000
MAX_CLASS_DISTANCE, MIN_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_JUDGED_WORDS = 0.3, 50
#: Words counted in a task before their counts go on.
FLUSH_WORDS = 2_000_000

CLASSES = ("lower", "upper", "digit", "stop", "symbol", "letter")
_CLASS = np.full(256, len(CLASSES), np.uint8)  # spaces and continuation bytes: counted, then left out
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3 if chr(_c) in ".,;:!?'\"()-" else 4
_CLASS[0xC0:] = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD_CHAR = np.ones(256, bool)
_WORD_CHAR[list(b" \t\n\x0b\x0c\r")] = False
_WORD_CHAR[0x80:0xC0] = False


def class_counts(buf: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS[buf], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of p to the same row of q; rows are distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _nearest(p: np.ndarray, q: np.ndarray) -> float:
    """The least distance of p, one row or a row for each of q, to the rows of q."""
    k = LANGUAGES_AT_ONCE
    return min(float(jensen_shannon(p if len(p) == 1 else p[i : i + k], q[i : i + k]).min()) for i in range(0, len(q), k))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to partial counts (lang, kind, key, n): kind 0 are classes, kind 1 hashes of words."""
    words: dict[str, list[np.ndarray]] = {}
    classes: dict[str, np.ndarray] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in words.items():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield _counts(lang, 1, key.view(np.int64), n)
        words.clear()

    for b in arrow_rows(batches):
        for lang, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            if not t or lang is None:
                continue
            h = word_hashes(t)[0]
            words.setdefault(lang, []).append(h)
            classes[lang] = classes.get(lang, 0) + class_counts(np.frombuffer(t, np.uint8))
            held += len(h)
            if held >= FLUSH_WORDS:
                yield from flush()
                held = 0
    yield from flush()
    for lang, n in classes.items():
        yield _counts(lang, 0, np.arange(len(CLASSES)), n)


def _counts(lang: str, kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "kind", "key", "n"])


def references(docs: DataFrame) -> dict:
    """Reference distributions of the languages, from all documents.

    langs: the languages; words: sorted hashes of all common words; pick: by language the places of its own; word and klass: distributions.
    """
    with scratch(docs.sparkSession):
        return _references(docs)


def _references(docs: DataFrame) -> dict:
    counts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_count, "lang string, kind int, key long, n long")
    counts = save(counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "counts")
    totals = counts.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_REFERENCE_WORDS)
    totals = save(totals, "totals")
    top = counts.where("kind = 1").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= COMMON)
    langs = {r["lang"]: r["total"] for r in totals.collect()}
    chosen = sorted(langs)
    common: dict[str, dict[int, int]] = {x: {} for x in chosen}
    for r in top.join(totals, "lang", "left_semi").collect():
        common[r["lang"]][r["key"]] = r["n"]
    klass = np.zeros((len(chosen), len(CLASSES)))
    place = {x: i for i, x in enumerate(chosen)}
    for r in counts.where("kind = 0").join(totals, "lang", "left_semi").collect():
        klass[place[r["lang"]], r["key"]] = r["n"]
    words = np.unique(np.array([k for c in common.values() for k in c], np.int64).view(np.uint64))
    pick = np.zeros((len(chosen), COMMON), np.int64)
    word = np.zeros((len(chosen), COMMON + 1))
    for i, lang in enumerate(chosen):
        items = sorted(common[lang].items(), key=lambda x: (-x[1], x[0]))
        for j, (k, n) in enumerate(items):
            pick[i, j] = np.searchsorted(words, np.array([k], np.int64).view(np.uint64))[0]
            word[i, j] = n / langs[lang]
        pick[i, len(items) :] = len(words)
        word[i, COMMON] = 1 - word[i].sum()
    return {"langs": frozenset(chosen), "words": words, "pick": pick, "word": word, "klass": klass / np.maximum(1, klass.sum(1, keepdims=True))}


def measure(t: bytes | None, lang: str | None, ref: dict) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class distance, word distance (None: not judged)."""
    if not t:
        return 0, 0, 0, 0, 0, None, None
    buf = np.frombuffer(t, np.uint8)
    h = word_hashes(t)[0]
    n = len(h)
    seen: set[bytes] = set()
    dup = 0
    for line in t.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 3:
        _, inverse, count = np.unique(grams(h, 3), return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        if twice.any():
            cover = np.zeros(n, bool)
            for j in range(3):
                cover[j : n - 2 + j] |= twice
            repeat = int(cover.sum())
    chars = int(np.count_nonzero(_WORD_CHAR[buf]))
    by_class = by_word = None
    if len(ref["klass"]) and (lang is None or lang in ref["langs"]):
        if chars >= MIN_CHARS:
            p = class_counts(buf)
            by_class = _nearest((p / max(1, p.sum()))[None], ref["klass"])
        if n >= MIN_JUDGED_WORDS:
            at = np.searchsorted(ref["words"], h)
            at[at == len(ref["words"])] = 0
            hit = at[ref["words"][at] == h]
            c = np.append(np.bincount(hit, minlength=len(ref["words"])), 0)[ref["pick"]] / n
            by_word = _nearest(np.concatenate([c, 1 - c.sum(1, keepdims=True)], 1), ref["word"])
    return n, chars, int(np.count_nonzero(_SYMBOL[buf])), dup, repeat, by_class, by_word


def _judge(ref: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t, lang, ref) for t, lang in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.float64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance"])

    return run


def quality_rules(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The measures of every row of docs, with base_failed and kept."""
    set_batches(docs.sparkSession)
    ref = references(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_judge(ref), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # the verdict is made on full precision; what is shown is rounded, as sums of logarithms differ by engine
    return rows.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


OP2_SQL = rf"""
with d as (
  select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), base as (
  select doc_id, lang, text, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols from d
), li as (select doc_id, unnest(string_split(text, chr(10))) as line from d
), dl as (select doc_id, (count(*) - count(distinct line))::bigint as n from li where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), tk as (select doc_id, lang, unnest(ws) as w, generate_subscripts(ws, 1) as i from d
), gr as (select doc_id, i, w || ' ' || lead(w) over x || ' ' || lead(w, 2) over x as g from tk window x as (partition by doc_id order by i)
), gc as (select doc_id, i, count(*) over (partition by doc_id, g) as c from gr where g is not null
), cv as (select doc_id, count(distinct i + k)::bigint as n from gc, range(3) r(k) where c > 1 group by doc_id
), ch as (
  select doc_id, lang, word_chars, unnest(range(6)) as k, unnest([length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')),
    length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')), length(regexp_replace(text, '[^#-&*+/<=>@\[-`{{-~]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))]) as n from base
), lt as (select lang, count(*) as total from tk where lang is not null group by lang having count(*) >= {MIN_REFERENCE_WORDS}
), rc as (select lang as ref, k, n / sum(n) over (partition by lang)::double as q from (select lang, k, sum(n)::double as n from ch where lang in (select lang from lt) group by lang, k)
), pc as (select doc_id, k, n / greatest(1, sum(n) over (partition by doc_id))::double as p from ch where word_chars >= {MIN_CHARS}
), wc as (select lang, w, count(*)::double as n from tk where lang in (select lang from lt) group by lang, w qualify row_number() over (partition by lang order by count(*) desc, w) <= {COMMON}
), rw as (select wc.lang as ref, w, n / total as q from wc join lt using (lang)
), cw as (select b.doc_id, b.n_words, r.ref, r.w, r.q, count(t.w) / b.n_words::double as p from base b cross join rw r left join tk t on t.doc_id = b.doc_id and t.w = r.w where b.n_words >= {MIN_JUDGED_WORDS} group by b.doc_id, b.n_words, r.ref, r.w, r.q
), ow as (select doc_id, ref, p, q from cw union all select doc_id, ref, 1 - sum(p), 1 - sum(q) from cw group by doc_id, ref
), oc as (select doc_id, ref, p, q from pc join rc using (k)
), js as (
  select kind, doc_id, ref, sqrt(greatest(0, least(1, (sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2))) as dist
  from (select 'c' as kind, * from oc union all select 'w', * from ow) group by kind, doc_id, ref
), m as (select doc_id, min(dist) filter (kind = 'c') as c, min(dist) filter (kind = 'w') as w from js
         where doc_id in (select doc_id from d where lang is null or lang in (select lang from lt)) group by doc_id
), o as (
  select base.doc_id, n_words, word_chars, n_symbols, coalesce(dl.n, 0) as n_dup_lines, coalesce(cv.n, 0) as n_repeat_words, m.c, m.w
  from base left join dl on dl.doc_id = base.doc_id left join cv on cv.doc_id = base.doc_id left join m on m.doc_id = base.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(c, 6) as class_distance, round(w, 6) as word_distance,
       n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and coalesce(c, 0) <= {MAX_CLASS_DISTANCE} and coalesce(w, 0) <= {MAX_WORD_DISTANCE} as kept
from o
"""
