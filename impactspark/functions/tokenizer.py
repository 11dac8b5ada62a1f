"""BERT-style tokenizer: basic cleaning and greedy WordPiece, with Arrow UDFs for columns of text.

Spark has no function for canonical decomposition, so this is the one step of a text query that runs in Python,
on texts of queries only; postings never pass through it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "[UNK]"
MAX_WORD_CHARS = 100
MAX_TOKEN_BYTES = 511
MAX_QUERY_TERMS = 512

_IDEOGRAPH = re.compile(
    "[㐀-䶿一-鿿豈-﫿"
    "\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf\U0002f800-\U0002fa1f]"
)
_ASCII_SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@lru_cache(maxsize=65_536)
def _clean(ch: str) -> str:
    """What stands for a character after cleaning: nothing, a space, an ideograph set apart, or itself."""
    if ch in "\t\n\r ":
        return " "
    kind = unicodedata.category(ch)
    if kind[0] == "C" or ch == "�":
        return ""
    if kind in ("Zs", "Zl", "Zp"):
        return " "
    return f" {ch} " if _IDEOGRAPH.match(ch) else ch


@lru_cache(maxsize=65_536)
def _is_sign(ch: str) -> bool:
    return ch in _ASCII_SIGNS or unicodedata.category(ch)[0] == "P"


def basic_words(text: str) -> Iterator[str]:
    """Lower-cased words without combining marks; every punctuation sign is a word of its own."""
    for word in "".join(map(_clean, text)).split():
        bare = [c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn"]
        at = 0
        for i, c in enumerate(bare):
            if _is_sign(c):
                if i > at:
                    yield "".join(bare[at:i])
                yield c
                at = i + 1
        if at < len(bare):
            yield "".join(bare[at:])


class WordPiece:
    """Greedy longest-match pieces over a vocabulary whose positions are the term ids."""

    def __init__(self, tokens: Iterable[str]):
        self.tokens = list(tokens)
        self.ids = {t: i for i, t in enumerate(self.tokens) if len(t.encode()) <= MAX_TOKEN_BYTES}
        self.longest = max(map(len, self.ids), default=0)
        self.unknown = self.ids.get(UNKNOWN)

    def pieces(self, word: str) -> list[int] | None:
        """The ids of a word, or None where it cannot be put together."""
        if len(word) > MAX_WORD_CHARS:
            return None
        out: list[int] = []
        at = 0
        while at < len(word):
            mark = "##" if at else ""
            for end in range(min(len(word), at + self.longest), at, -1):
                got = self.ids.get(mark + word[at:end])
                if got is not None:
                    out.append(got)
                    at = end
                    break
            else:
                return None
        return out

    def encode(self, text: str | None, limit: int | None = None) -> list[int]:
        """Term ids of a text; words that fail are [UNK], or nothing where the vocabulary has none."""
        out: list[int] = []
        for word in basic_words(text or ""):
            got = self.pieces(word)
            out += got if got is not None else [self.unknown] if self.unknown is not None else []
            if limit is not None and len(out) >= limit:
                return out[:limit]
        return out


def token_ids(text: Column, tokens: list[str], limit: int | None = MAX_QUERY_TERMS) -> Column:
    """array<int> of the term ids of a text column; null stays null."""
    held: list[WordPiece] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(WordPiece(tokens))
        return pa.array([None if t is None else held[0].encode(t, limit) for t in texts.to_pylist()], pa.list_(pa.int32()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(text)


def basic_tokens(text: Column) -> Column:
    """array<string> of the words of a text column after cleaning, before WordPiece; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(basic_words(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(text)


def sparse_tokens(text: Column, tokens: list[str]) -> Column:
    """JSON array of the tokens of a text, uncapped; null stays null."""
    held: list[WordPiece] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(WordPiece(tokens))
        out = [None if t is None else json.dumps([held[0].tokens[i] for i in held[0].encode(t)], ensure_ascii=False, separators=(",", ":")) for t in texts.to_pylist()]
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text)


def ascii_words(text: Column) -> Column:
    """array<string> of runs of a-z in the lower-cased text; stays in the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
