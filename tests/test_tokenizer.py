import pytest
from conftest import small_vocab
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from impactspark.functions.tokenizer import WordPiece, ascii_words, basic_words, sparse_tokens, token_ids


@pytest.mark.parametrize(
    "text, words",
    [
        ("Hello, World!", ["hello", ",", "world", "!"]),
        ("naïve Ünïcode", ["naive", "unicode"]),
        ("a\tb\nc\rd", ["a", "b", "c", "d"]),
        ("中文 text", ["中", "文", "text"]),
        ("x\x00y�z", ["xyz"]),
        (" a\xa0b", ["a", "b"]),
        ("don't stop", ["don", "'", "t", "stop"]),
        ("$5 ^ 6", ["$", "5", "^", "6"]),
        ("ΟΔΟΣ", ["οδος"]),
        ("", []),
        ("​", []),
    ],
)
def test_basic_words(text, words):
    assert list(basic_words(text)) == words


def test_longest_piece_wins_and_failures_vanish():
    w = WordPiece(small_vocab())
    assert w.encode("maples") == [12, 16]
    assert w.encode("zzzqqq river") == [10]
    assert w.encode(None) == []


def test_unknown_word_and_long_word_are_unk():
    w = WordPiece(["[UNK]", "a", "##a"])
    assert w.encode("b a") == [0, 1]
    assert w.encode("a" * 100) == [1] + [2] * 99
    assert w.encode("a" * 101) == [0]
    assert w.encode("a a a", limit=2) == [1, 1]


def test_token_too_long_never_matches():
    assert WordPiece(["x" * 512, "[UNK]"]).encode("x" * 90) == [1]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_pieces_spell_the_words(text):
    letters = sorted({c for w in basic_words(text) for c in w})
    w = WordPiece(["[UNK]", *letters, *(f"##{c}" for c in letters)])
    spelled = "".join(w.tokens[i].removeprefix("##") if w.tokens[i] != "##" else "##" for i in w.encode(text) if i)
    assert len(w.encode(text)) == sum(len(x) for x in basic_words(text)) or "#" in text
    assert spelled == "".join(basic_words(text)) or "#" in text


def test_columns(spark):
    df = spark.createDataFrame([(1, "maples River"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: (r["i"], r["j"], r["w"]) for r in df.select("id", token_ids(F.col("text"), small_vocab()).alias("i"), sparse_tokens(F.col("text"), small_vocab()).alias("j"), ascii_words(F.col("text")).alias("w")).collect()}
    assert got[1] == ([12, 16, 10], '["maple","##s","river"]', ["maples", "river"])
    assert got[2] == (None, None, None)
    assert got[3] == ([], "[]", [])
