import hashlib
import json
import sqlite3
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from conftest import hits, put, small_vocab
from pyspark.sql import functions as F

from impactspark.functions import models
from impactspark.functions.encoders import HeadEncoder, TransformerEncoder, check_max_seq, head_weights, torch_loader, wordpiece_states
from impactspark.operators.index import SparseIndex
from impactspark.session import scratch_dir, shared_file
from impactspark.sources.jsonl import read_jsonl
from impactspark.sources.sidecar import Sidecar, read_sidecar, write_sidecar
from impactspark.sources.sqlite_file import read_table
from impactspark.sources.vocabulary import parse_vocab_json, read_vocab_file, vocab_frame, vocab_json


@pytest.mark.parametrize("text, message", [("a\nb\na", "duplicate or too long"), ("a\n\nb", "is empty"), ("", "empty"), ("x" * 512, "duplicate or too long")])
def test_bad_vocab_files(tmp_path, text, message):
    (tmp_path / "v.txt").write_text(text)
    with pytest.raises(ValueError, match=message):
        read_vocab_file(str(tmp_path / "v.txt"))


def test_vocab_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\r\nb\r\nüñ\r\n\n")
    tokens = read_vocab_file(str(tmp_path / "v.txt"))
    assert tokens == ["a", "b", "üñ"]
    assert parse_vocab_json('["\\ud83d\\ude00", "\\u00e9"]') == ["😀", "é"] and parse_vocab_json(vocab_json(tokens)) == tokens
    assert [(r["term"], r["token"]) for r in vocab_frame(spark, tokens).orderBy("term").collect()] == [(0, "a"), (1, "b"), (2, "üñ")]
    ix = SparseIndex(spark, str(tmp_path / "ix"), vocab=str(tmp_path / "v.txt"))
    assert ix.tokens == tokens
    with pytest.raises(FileNotFoundError, match="cannot open"):
        read_vocab_file(str(tmp_path / "none"))


def test_jsonl(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "1", "text": "river", "title": "T"}\n{"id": 2, "text": "x"}\n')
    assert sorted(tuple(r) for r in read_jsonl(spark, str(tmp_path / "d.jsonl")).collect()) == [("1", "T", "river"), ("2", "", "x")]


def a_sidecar(activation=0, hidden=8, terms=12):
    g = np.random.default_rng(3)
    a = lambda *s: g.normal(size=s).astype(np.float32)
    return Sidecar(a(hidden, hidden), a(hidden), a(hidden), a(hidden), a(terms, hidden), a(terms), np.abs(a(terms)), [f"w{i}" for i in range(terms)], activation)


def test_sidecar_round_trip_and_refusals(tmp_path):
    p = str(tmp_path / "m.sprs")
    write_sidecar(p, a_sidecar(1))
    s = read_sidecar(p)
    assert s.activation == 1 and s.tokens[3] == "w3" and np.array_equal(s.decoder_w, a_sidecar().decoder_w) and len(s.sha256) == 64
    data = (tmp_path / "m.sprs").read_bytes()
    for bad in (b"", b"XXXX" + data[4:], data[:4] + b"\x02" + data[5:], data[:-3]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            read_sidecar(str(tmp_path / "bad"))


@pytest.mark.parametrize("activation", [0, 1])
def test_head_against_plain_loops(activation):
    import math

    s, states = a_sidecar(activation), np.random.default_rng(5).normal(size=(3, 8)).astype(np.float32)
    terms, w = head_weights(states, s, min_weight=0.0)
    best = {}
    for row in states.astype(float):
        x = [sum(s.dense_w[o, i] * row[i] for i in range(8)) + s.dense_b[o] for o in range(8)]
        x = [0.5 * v * (1 + math.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v**3))) for v in x]
        m = sum(x) / 8
        sd = math.sqrt(sum((v - m) ** 2 for v in x) / 8 + 1e-12)
        x = [(v - m) / sd * s.norm_gain[i] + s.norm_bias[i] for i, v in enumerate(x)]
        for t in range(12):
            best[t] = max(best.get(t, -1e9), sum(s.decoder_w[t, i] * x[i] for i in range(8)))
    want = {t: math.log1p(v + s.decoder_b[t]) for t, v in best.items() if v + s.decoder_b[t] > 0}
    want = {t: math.log1p(v) if activation else v for t, v in want.items()}
    assert dict(zip(terms.tolist(), w.tolist(), strict=True)) == pytest.approx(want, abs=1e-4)


def test_head_encoder_end_to_end(spark, tmp_path):
    s = a_sidecar()
    models.register_model("head", HeadEncoder("head", s, wordpiece_states(s.tokens, 8), max_seq=16))
    try:
        ix = SparseIndex(spark, str(tmp_path / "ix"), model="head")
        assert put(spark, ix, ["w1 w2", " ".join(["w3"] * 20), ""]) == 3
        rows = {r["id"]: (r["ntokens"], r["truncated"]) for r in ix.live.collect()}
        assert rows[1] == (2, False) and rows[2] == (20, True)
        assert ix.match("w1").count() > 0
    finally:
        models.unregister_model("head")


def test_registry(tmp_path, monkeypatch, fake_model):
    for n in (15, 513):
        with pytest.raises(ValueError, match="max_seq must be in"):
            check_max_seq(n)
    with pytest.raises(LookupError):
        models.get_model("nobody")
    names = [f"m{i}" for i in range(models.MAX_MODELS - len(models._MODELS))]
    for n in names:
        models.register_model(n, models.get_model("fake"))
    with pytest.raises(RuntimeError, match="registry full"):
        models.register_model("one-more", models.get_model("fake"))
    assert models.register_model("fake", models.get_model("fake")) == "ok"
    for n in names:
        models.unregister_model(n)
    monkeypatch.setenv("IMPACTSPARK_CACHE", str(tmp_path / "cache"))
    with pytest.raises(KeyError, match="unknown model alias"):
        models.model_files("nope")
    with pytest.raises(ValueError, match="quant"):
        models.model_files("mini", "q4")
    with pytest.raises(FileNotFoundError):
        models.model_files("mini")
    folder = tmp_path / "cache" / "mini"
    folder.mkdir()
    for name in ("mini_q8.gguf", "mini.sprs"):
        (folder / name).touch()
    assert models.model_files("mini")[1].name == "mini.sprs"


@pytest.mark.parametrize("mode", ["u8", "f32"])
def test_sqlite_round_trip(spark, tmp_path, fake_model, mode):
    ix = SparseIndex(spark, str(tmp_path / "ix"), model=fake_model, weight_mode=mode)
    put(spark, ix, ["river stone maple", "river", "north south"])
    ix.delete(rowid=2)
    file = str(tmp_path / "out.db")
    ix.export_sqlite(file)
    with sqlite3.connect(file) as db:
        docs, ws = next(iter(db.execute("select p.docs, p.ws from postings p where p.t = ?", (10,))))
        assert np.frombuffer(docs, "<i4").tolist() == [1, 2]
        assert np.frombuffer(ws, dict(u8=np.uint8, f32="<f4")[mode]).tolist() == ([80, 80] if mode == "u8" else [2.0, 2.0])
    assert sorted(r["doc_id"] for r in read_table(spark, file, "postings").where("term = 10").collect()) == [1, 2]
    assert read_table(spark, file, "vocab").count() == 200
    back = SparseIndex.import_sqlite(spark, file, str(tmp_path / "back"))
    assert hits(back.match("river stone")) == hits(ix.match("river stone")) == [(1, 6.0)]


def test_sqlite_refusals(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table meta(k text, v text)")
        db.execute("insert into meta values ('format', 'any/2')")
    with pytest.raises(ValueError, match="not a"):
        SparseIndex.import_sqlite(spark, str(tmp_path / "a.db"), str(tmp_path / "x"))
    with pytest.raises(FileNotFoundError):
        SparseIndex.import_sqlite(spark, str(tmp_path / "none.db"), str(tmp_path / "x"))


def test_old_sqlite_file_without_token_counts(spark, tmp_path):
    with sqlite3.connect(tmp_path / "old.db") as db:
        db.executescript("create table meta(k, v); create table docs(id integer primary key, ext_id, title, body, meta, deleted);")
        db.execute("insert into meta values ('format', 'any/1')")
        db.execute("insert into docs values (1, 'a', 't', null, null, 0)")
    r = read_table(spark, str(tmp_path / "old.db"), "docs").first()
    assert r["ext_id"] == "a" and r["ntokens"] is None and r["deleted"] is False


def test_cli(spark, tmp_path, capsys):
    from impactspark.cli import main

    (tmp_path / "d.jsonl").write_text('{"id": "a", "text": "river stone", "title": "T"}\n{"id": "b", "text": "south flat"}\n')
    ix = str(tmp_path / "ix")
    main(["build", ix, str(tmp_path / "d.jsonl")])
    main(["search", ix, "river"])
    main(["search", ix, '{"south": 1}', "--terms"])
    main(["info", ix])
    main(["sync", ix])
    main(["tokens", ix, "River!"])
    spark.createDataFrame([(7, "river", "flat")], "pk long, x string, y string").write.parquet(str(tmp_path / "t"))
    main(["attach", ix, str(tmp_path / "t"), "x,y", "--id-col", "pk"])
    out = capsys.readouterr().out
    assert "indexed 2 docs" in out and "  a  T" in out and "  b  " in out and '"live_docs": 2' in out and "synced 0 docs" in out and '["river"]' in out and "synced 1 rows" in out
    assert small_vocab()


def test_the_command_line_encodes_alike_in_every_process(spark, tmp_path):
    words = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600))
    (tmp_path / "d.jsonl").write_text(json.dumps({"id": "a", "text": words}) + "\n")
    spark.createDataFrame([("b", words)], "pk string, x string").write.parquet(str(tmp_path / "t"))
    ix = str(tmp_path / "ix")
    for command in (["build", ix, str(tmp_path / "d.jsonl")], ["attach", ix, str(tmp_path / "t"), "x", "--id-col", "pk"]):
        subprocess.run([sys.executable, "-m", "impactspark", *command], check=True, cwd=Path(__file__).resolve().parent.parent, capture_output=True, timeout=300)
    got = SparseIndex(spark, ix, query_only=True)
    docs = got.live.select("ext_id", "ntokens", "truncated").collect()
    assert sorted(tuple(r) for r in docs) == [("a", 600, True), ("b", 600, True)]
    per = {r["doc_id"]: r["n"] for r in got.postings.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert list(per.values()) == [512, 512]


def test_fetching_models(tmp_path, monkeypatch):
    monkeypatch.setenv("IMPACTSPARK_CACHE", str(tmp_path / "cache"))
    source = tmp_path / "source" / "mini"
    source.mkdir(parents=True)
    for name in ("mini_q8.gguf", "mini.sprs"):
        (source / name).write_bytes(name.encode() * 1000)
    with pytest.raises(FileNotFoundError, match="no source"):
        models.fetch("mini")
    url = (tmp_path / "source").as_uri()
    with pytest.raises(ValueError, match="another hash"):
        models.fetch("mini", source=url, sha256={"mini_q8.gguf": "0" * 64})
    assert not list((tmp_path / "cache" / "mini").iterdir())
    want = hashlib.sha256((source / "mini.sprs").read_bytes()).hexdigest()
    files = models.fetch("mini", source=url, sha256={"mini.sprs": want})
    assert [f.read_bytes() for f in files] == [(source / f.name).read_bytes() for f in files]
    (source / "mini.sprs").unlink()
    assert models.fetch("mini") == files  # what is there is not fetched again


def test_transformer_encoder(spark, tmp_path):
    s = a_sidecar()
    s.tokens[:3] = ["[PAD]", "[CLS]", "[SEP]"]
    seen = []

    def load():
        def forward(ids, mask):
            seen.append((ids.tolist(), mask.tolist()))
            return np.eye(8, dtype=np.float32)[ids % 8] * mask[..., None]

        return forward

    e = TransformerEncoder("t", s, load, max_seq=16, batch_size=2)
    got = e.hidden(["w3 w4", " ".join(["w5"] * 40), ""], 16)
    assert [(x.shape[0], n) for x, n in got] == [(4, 4), (16, 42), (2, 2)]
    assert seen[0][0][0] == [1, 3, 4, 2] + [0] * 12 and seen[0][0][1] == [1, *[5] * 14, 2] and seen[0][1][0] == [1] * 4 + [0] * 12 and len(seen) == 2
    models.register_model("t", e)
    try:
        ix = SparseIndex(spark, str(tmp_path / "ix"), model="t")
        assert put(spark, ix, ["w3 w4", " ".join(["w5"] * 40)]) == 2
        assert {r["id"]: (r["ntokens"], r["truncated"]) for r in ix.live.collect()} == {1: (4, False), 2: (42, True)}
    finally:
        models.unregister_model("t")
    with pytest.raises(RuntimeError, match="torch and transformers"):
        torch_loader("nowhere")()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Session:
        def __init__(self, master, folder=None):
            self.conf, self.sparkContext = Conf(folder), type("C", (), {"master": master})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session("spark://host:7077"))
    assert scratch_dir(Session("yarn", "hdfs://host/x/")) == "hdfs://host/x" and scratch_dir(Session("local[4]")).startswith("file:")
    with pytest.raises(ValueError, match="no mounted folder"):
        shared_file(Session("yarn", "hdfs://host/x"), "a.db")
    assert scratch_dir(spark)
