"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, schemes and
identifier cues in any case. At each anchor a deterministic parser expands to both sides and validates what it has: the
domain of an email, the parts of an address, Luhn sums of cards, the length of phone numbers, check digits of
IBANs, and the form of an identifier that follows a cue. Base kinds (email, ip, card, phone) find what a
leftmost scan with their patterns finds; url, iban and account are added.

Offsets are code points, ends exclusive. n_personal counts all spans but those of urls, which many clean texts hold. Nulls and empty texts have no spans. Rows that repeat are treated alike;
an empty table gives an empty result. Only doc_id and text are read, texts whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm.common import set_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "iban", "url")
KINDS = (*BASE, *ADDED)
CUES = ("token", "account", "acct", "api_key", "apikey", "secret", "password", "passport", "ssn", "licence no", "license no", "customer id", "user id")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'{}|\\^`]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_VALUE = re.compile(r"[\x20\t]*(?i:no\.?|number|nr\.?|is)?[\x20\t]*[:=#][\x20\t]*[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,})")
_CUE = re.compile(r"(?:^|[^A-Za-z0-9])(?:" + "|".join(CUES) + ")$", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, "d")
    a.add_word("@", "@")
    a.add_word("+", "+")
    a.add_word("://", "u")
    for cue in CUES:
        a.add_word(cue, "c")
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []
_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """The text with A-Z in lower case, as long as it was."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of BASE and ADDED, then by start."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(KINDS, 0)  # where the scan of each kind goes on
    run = 0  # digits before this belong to a run that was looked at
    for end, kind in _AUTOMATON[0].iter(_lower(text)):
        if kind == "d":
            if end < run:
                continue
            run = end + 1
            while run < len(text) and "0" <= text[run] <= "9":
                run += 1
            if end >= after["ip"] and (m := _IP.match(text, end)):
                after["ip"] = m.end()
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                    out["ip"].append(m.span())
            if end >= after["card"] and (m := _CARD.match(text, end)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            s = end - 2
            if s >= after["iban"] and text[s] in _UPPER and text[s + 1] in _UPPER and not (s and text[s - 1].isalnum()) and (m := _IBAN.match(text, s)):
                after["iban"] = m.end()
                v = m[0][4:] + m[0][:4]
                if int("".join(str(int(c, 36)) for c in v)) % 97 == 1:
                    out["iban"].append(m.span())
        elif kind == "@":
            s = end
            while s > after["email"] and text[s - 1] in _LOCAL:
                s -= 1
            if s < end and (m := _DOMAIN.match(text, end + 1)):
                after["email"] = m.end()
                out["email"].append((s, m.end()))
        elif kind == "+":
            if end >= after["phone"] and (m := _PHONE.match(text, end)):
                after["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "u":
            s = end - 2
            while s > after["url"] and text[s - 1] in _SCHEME:
                s -= 1
            if s < end - 2 and (m := _URL.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?)]"))
                if "." in text[end + 1 : stop]:
                    out["url"].append((s, stop))
                    after["url"] = stop
        elif end >= after["account"] and (m := _VALUE.match(text, end + 1)):
            # a cue counts at the start of a word, and what follows must hold a digit
            if _CUE.search(text[max(0, end - 16) : end + 1]) and any("0" <= c <= "9" for c in m[1]):
                out["account"].append(m.span(1))
                after["account"] = m.end(1)
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced by their kind; overlapping ones become one, named by the first."""
    parts, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _scan(masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {k: [] for k in KINDS}
            sha, spans, texts = [], [], []
            for t in b.column(1).to_pylist():
                found = find(t)
                for k in KINDS:
                    n[k].append(sum(x[0] == k for x in found))
                base = ",".join(f"{k}:{s}:{e}" for k, s, e in found if k in BASE)
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in found))
                if masked:
                    texts.append(None if t is None else mask(t, found) if found else t)
            personal = [sum(row) for row in zip(*(n[k] for k in KINDS if k != "url"), strict=True)]
            cols = [b.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(personal, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "n_personal", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())] if masked else cols, [*names, "masked_text"] if masked else names)

    return run


def find_pii(docs: DataFrame, masked: bool = True) -> DataFrame:
    """Counts and spans of every row of docs, with masked_text if asked for."""
    set_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in (*KINDS, "personal")) + ", base_sha256 string, spans string"
    return rows.mapInArrow(_scan(masked), schema + ", masked_text string" * masked)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), masked=False)


# a value of six characters or more with a digit, without looking ahead: by where its first digit stands
_V, _L = "[A-Za-z0-9_-]", "[A-Za-z_-]"
_SQL_VALUE = f"(?:[0-9]{_V}{{5,}}|[A-Za-z](?:[0-9]{_V}{{4,}}|{_L}[0-9]{_V}{{3,}}|{_L}{{2}}[0-9]{_V}{{2,}}|{_L}{{3}}[0-9]{_V}+|{_L}{{4,}}[0-9]{_V}*))"

#: All kinds by leftmost scans with a pattern each; a match's place is where its text first stands after the one before.
OP5_SQL = rf"""
with recursive d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents
), p(ord, kind, pattern) as (values
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (4, 'account', '(?:^|[^A-Za-z0-9])(?i:{"|".join(CUES)})[\x20\t]*(?i:no\.?|number|nr\.?|is)?[\x20\t]*[:=#][\x20\t]*["'']?{_SQL_VALUE}'),
  (5, 'iban', '(?:^|[^\p{{L}}\p{{N}}])[A-Z][A-Z][0-9][0-9][A-Z0-9]{{11,30}}'),
  (6, 'url', '[A-Za-z]+://[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}<>"''{{}}|\\^`]+')
), a as (
  select row, text, 0 as ord, regexp_extract_all(text, (select pattern from p where ord = 0)) as ms from d
  union all select row, text, 1, regexp_extract_all(text, (select pattern from p where ord = 1)) from d
  union all select row, text, 2, regexp_extract_all(text, (select pattern from p where ord = 2)) from d
  union all select row, text, 3, regexp_extract_all(text, (select pattern from p where ord = 3)) from d
  union all select row, text, 4, regexp_extract_all(text, (select pattern from p where ord = 4)) from d
  union all select row, text, 5, regexp_extract_all(text, (select pattern from p where ord = 5)) from d
  union all select row, text, 6, regexp_extract_all(text, (select pattern from p where ord = 6)) from d
), w as (
  select row, ord, 0 as i, 0::bigint as e from a where len(ms) > 0
  union all
  select w.row, w.ord, w.i + 1, w.e + instr(substr(a.text, w.e + 1), a.ms[w.i + 1]) - 1 + len(a.ms[w.i + 1])
  from w join a on a.row = w.row and a.ord = w.ord where w.i < len(a.ms)
), m as (
  select w.row, w.ord, p.kind, e, a.ms[i] as m,
         case p.kind when 'account' then regexp_extract(a.ms[i], '[A-Za-z0-9_-]+$') when 'iban' then regexp_extract(a.ms[i], '[A-Z0-9]+$')
                     when 'url' then regexp_replace(a.ms[i], '[.,;:!?)\]]+$', '') else a.ms[i] end as v
  from w join a on a.row = w.row and a.ord = w.ord join p on p.ord = w.ord where i > 0
), n as (
  select *, regexp_replace(v, '[^0-9]', '', 'g') as g, case when kind in ('account', 'iban') then e - len(v) else e - len(m) end as s from m
), k as (
  select row, ord, kind, s, s + len(v) as stop from n where case kind
    when 'ip' then len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 or try_cast(x as bigint) > 255)) = 0
    when 'card' then len(g) between 16 and 19 and list_sum(list_transform(range(len(g)), lambda j: case when j % 2 = 0 then substr(g, len(g) - j, 1)::int
      else (2 * substr(g, len(g) - j, 1)::int) // 10 + (2 * substr(g, len(g) - j, 1)::int) % 10 end)) % 10 = 0
    when 'phone' then len(g) between 8 and 15
    when 'account' then len(g) > 0
    when 'iban' then list_reduce(list_prepend(0, list_transform(string_split(substr(v, 5) || left(v, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)),
      lambda x, c: case when c > 9 then (x * 100 + c) % 97 else (x * 10 + c) % 97 end) = 1
    when 'url' then contains(split_part(v, '://', 2), '.')
    else true end
), o as (
  select row, {", ".join(f"count(*) filter (kind = '{x}') as n_{x}" for x in KINDS)}, count(*) filter (kind <> 'url') as n_personal,
         string_agg(kind || ':' || s || ':' || stop, ',' order by ord, s) filter (ord < {len(BASE)}) as base, string_agg(kind || ':' || s || ':' || stop, ',' order by ord, s) as spans
  from k group by row
)
select doc_id, {", ".join(f"coalesce(n_{x}, 0) as n_{x}" for x in (*KINDS, "personal"))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join o on o.row = d.row
"""
