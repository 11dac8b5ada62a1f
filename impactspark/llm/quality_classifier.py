"""Quality classifier by co-training.

Two classifiers see a document from two sides. The text view has what stands in the text: pairs of neighbouring
character classes, how much repeats, word lengths, and hashed words. The metadata view has what describes the
page: its language and source, hashed, its length in characters, words and lines. Each round, both are fitted, both
judge every document of the table that is not learned from yet, and each hands the documents that it is most sure of,
with its verdict, to the other's training rows. At the end each view is calibrated on labelled rows kept aside, and
their calibrated logits are combined by a third regression on the same rows.

Both views of every document are written once as a table, in half precision, which rounds and final scores read.
Fitting takes at most LABELLED labelled documents, chosen by a hash of the id, and at most PER_ROUND pseudo-labelled
ones a view and round, the surest of all; documents with equal views count once. Rows with crc32(doc_id) mod 4 = 2 are
never learned from, nor are rows without id. Everything is scored.

Nulls and empty texts are scored like any other document, from zero counts; a null language or source is a value
of its own. Labelled ids that repeat count once, by their least views. An empty table gives an empty result; without
labels of both kinds every document scores 0.5 and is kept. Rows that repeat score alike. Only doc_id, text, lang,
source and n_chars are read, texts whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactspark.llm.common import arrow_rows, grams, save, scratch, set_batches, utf8, word_hashes
from impactspark.llm.linear import fit_dense, platt, sigmoid
from impactspark.llm.quality_rules import _CLASS, CLASSES

LABELLED = 6_000
ROUNDS, PER_ROUND = 4, 400
#: A view hands on verdicts only from a confidence on at which at most this share of calibration rows is wrong.
MAX_WRONG = 0.01
WORD_BUCKETS, LANG_BUCKETS, SOURCE_BUCKETS = 256, 16, 64
#: At most this share of the good calibration rows may fall below the threshold, which is 0.5 at most.
MAX_LOSS = 0.005

_K = len(CLASSES) + 1
N_TEXT = _K * _K + 9 + WORD_BUCKETS
N_META = 5 + LANG_BUCKETS + SOURCE_BUCKETS


def text_view(t: bytes | None) -> np.ndarray:
    out = np.zeros(N_TEXT, np.float32)
    if not t:
        return out
    h, s, e = word_hashes(t)
    n = len(h)
    c = _CLASS[np.frombuffer(t, np.uint8)]
    pair = np.bincount(c[:-1].astype(np.int64) * _K + c[1:], minlength=_K * _K)
    out[: _K * _K] = np.sqrt(pair / max(1, len(c) - 1))
    if not n:
        return out
    length = e - s
    out[_K * _K] = length.mean() / 10
    out[_K * _K + 1] = min(3.0, length.std() / 10)
    if n >= 3:
        _, inverse, twice = np.unique(grams(h, 3), return_inverse=True, return_counts=True)
        out[_K * _K + 3] = (twice[inverse] > 1).mean()
        out[_K * _K + 4] = (h[1:] == h[:-1]).mean()
    out[_K * _K + 5] = 1 / np.sqrt(n)
    count = np.unique(h, return_counts=True)[1]
    out[_K * _K + 2] = len(count) / n
    out[_K * _K + 6] = count.max() / n
    out[_K * _K + 7] = (length == 1).mean()
    out[_K * _K + 8] = n < 50
    out[_K * _K + 9 :] = np.sqrt(np.bincount((h >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, minlength=WORD_BUCKETS) / n)
    return out


def _bucket(v: str | None, n: int) -> int:
    return 0 if v is None else 1 + zlib.crc32(v.encode()) % (n - 1)


def meta_view(t: bytes | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(N_META, np.float32)
    words = len(t.split()) if t else 0
    lines = t.count(b"\n") + 1 if t else 0
    chars = n_chars if n_chars is not None and n_chars >= 0 else len(t or b"")
    out[:5] = np.log1p(chars) / 10, np.log1p(words) / 10, np.log1p(lines) / 5, chars / (words + 1) / 20, words / (lines + 1) / 100
    out[5 + _bucket(lang, LANG_BUCKETS)] = 1
    out[5 + LANG_BUCKETS + _bucket(source, SOURCE_BUCKETS)] = 1
    return out


def _packed(rows: list[np.ndarray]) -> list[bytes]:
    return [np.clip(x, -6e4, 6e4).astype(np.float16).tobytes() for x in rows]


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float16).reshape(-1, width).astype(np.float64)


def _views(texts: list, lang: list, source: list, n_chars: list) -> tuple[list[bytes], list[bytes]]:
    return _packed([text_view(t) for t in texts]), _packed([meta_view(*r) for r in zip(texts, lang, source, n_chars, strict=True)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow_rows(batches):
        x, m = _views(utf8(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "x", "m"])


def _columns(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), n.cast("long").alias("n_chars"))


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(labels: DataFrame, label: str, labelled: int) -> DataFrame:
    """(doc_id, label) of at most `labelled` rows that may be learned from, each id once: the first by a hash of the id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~_held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(labelled)


def sample(docs: DataFrame, labels: DataFrame, label: str, labelled: int) -> DataFrame:
    """The rows of docs that may be learned from, with their label; of rows that repeat an id the least."""
    rows = docs.join(F.broadcast(training_rows(labels, label, labelled)), "doc_id")
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")


def views_of(docs: DataFrame) -> DataFrame:
    """doc_id, both views packed, and a hash of them, of every row of docs."""
    rows = _columns(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return save(rows.mapInArrow(_features, f"doc_id {kind}, x binary, m binary").withColumn("h", F.xxhash64("x", "m")), "views")


def _sure(p: np.ndarray, right: np.ndarray) -> float:
    """The least confidence p at which, on calibration rows, verdicts are as good as MAX_WRONG asks; above 1 if never."""
    order = np.argsort(-p, kind="stable")
    wrong = (np.cumsum(~right[order]) + 1) / (np.arange(len(p)) + 2)
    ok = np.flatnonzero(wrong <= MAX_WRONG)
    return float(p[order][ok[-1]]) if len(ok) else 2.0


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(0), x.std(0) + 1e-3


def _probability(v: dict, a: np.ndarray) -> np.ndarray:
    return sigmoid(v["scale"][0] * (((a - v["mean"]) / v["std"]) @ v["w"] + v["b"]) + v["scale"][1])


def _surest(views: list[dict], groups: list[dict]):
    """(h, x, m) to rows (g, sure, h): for each group the rows of a task that its view is surest of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, float]] = [{} for _ in groups]

        def prune(g: int) -> None:
            best[g] = dict(sorted(best[g].items(), key=lambda r: (-r[1], r[0]))[: groups[g]["n"]])

        for b in batches:
            h = b.column(0).to_numpy()
            p = [_probability(v, _matrix(b.column(i + 1).to_pylist(), len(v["mean"]))) for i, v in enumerate(views)]
            for g, group in enumerate(groups):
                # rounded, so that the order doesn't hang on how rows fall into batches
                sure = np.round(p[group["view"]] if group["value"] else 1 - p[group["view"]], 9)
                for i in np.flatnonzero(sure >= group["least"]).tolist():
                    if int(h[i]) not in group["given"]:
                        best[g][int(h[i])] = float(sure[i])
                if len(best[g]) > 8 * group["n"]:
                    prune(g)
        for g in range(len(groups)):
            prune(g)
        rows = [(g, s, h) for g, found in enumerate(best) for h, s in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], ["g", "sure", "h"])

    return run


def hand_over(pool: DataFrame, views: list[dict], groups: list[dict]) -> list[tuple[int, int, bytes, bytes]]:
    """(g, h, x, m): for each group the n rows of pool(h, x, m) that its view is surest of, from `least` on."""
    found = pool.select("h", "x", "m").mapInArrow(_surest(views, groups), "g int, sure double, h long").distinct()
    most = F.element_at(F.array(*[F.lit(g["n"]) for g in groups]), F.col("g") + 1)
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("sure"), "h"))
    chosen = found.withColumn("r", rank).where(F.col("r") <= max(g["n"] for g in groups)).where(F.col("r") <= most).select("g", "h")
    # at most n rows a group, which bounds what is broadcast and what comes to the driver
    rows = pool.select("h", "x", "m").join(F.broadcast(chosen), "h").groupBy("g", "h").agg(F.min(F.struct("x", "m")).alias("r"))
    return sorted((r["g"], r["h"], bytes(r["r"]["x"]), bytes(r["r"]["m"])) for r in rows.collect())


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> dict | None:
    """The model of a table of views, or None where there are not labels of both kinds."""
    got = sample(table.select("doc_id", "x", "m"), labels, label, labelled).toPandas().sort_values("doc_id")
    y = got["label"].to_numpy()
    if not ((y == 0).any() and (y == 1).any()):
        return None
    pool = table.where(F.col("doc_id").isNotNull() & ~_held_out()).join(F.broadcast(training_rows(labels, label, labelled)), "doc_id", "left_anti")
    turn = np.array([zlib.crc32(b"calibrate:%d" % int(i)) % 3 for i in got["doc_id"]])
    calib = turn == 0
    train = ~calib
    if min((y[m] == k).sum() for m in (calib, train) for k in (0, 1)) == 0:
        calib = train = np.ones(len(y), bool)
    prior = y[train].mean()
    views: list[dict] = []
    for c, d in (("x", N_TEXT), ("m", N_META)):
        a = _matrix(list(got[c]), d)
        mean, std = _standard(a)
        views.append({"x": a, "mean": mean, "std": std, "more": [a[train]], "y": [y[train].astype(float)]})
    given: list[set[int]] = [set(), set()]
    for r in range(rounds + 1):
        for v in views:
            v["w"], v["b"] = fit_dense((np.concatenate(v["more"]) - v["mean"]) / v["std"], np.concatenate(v["y"]))
            v["z"] = ((v["x"] - v["mean"]) / v["std"]) @ v["w"] + v["b"]
            v["scale"] = platt(v["z"][calib], y[calib])
        if r == rounds:
            break
        groups = []
        for me in (0, 1):
            p = sigmoid(views[me]["scale"][0] * views[me]["z"] + views[me]["scale"][1])
            for value, share, sure in ((1, prior, p), (0, 1 - prior, 1 - p)):
                groups.append({"view": me, "value": value, "n": max(1, int(per_round * share)), "least": _sure(sure[calib], y[calib] == value), "given": given[1 - me]})
        groups = [g for g in groups if g["least"] <= 1]
        if not groups:
            continue
        chosen = hand_over(pool, [{k: v[k] for k in ("mean", "std", "w", "b", "scale")} for v in views], groups)
        for g, group in enumerate(groups):
            rows = [c for c in chosen if c[0] == g]
            if rows:
                other = 1 - group["view"]
                views[other]["more"].append(_matrix([c[2 + other] for c in rows], len(views[other]["mean"])))
                views[other]["y"].append(np.full(len(rows), float(group["value"])))
                given[other] |= {c[1] for c in rows}
    both = np.stack([v["scale"][0] * v["z"] + v["scale"][1] for v in views], 1)
    w, b = fit_dense(both[calib] / 5, y[calib].astype(float), l2=1e-4)
    final = sigmoid(both @ (w / 5) + b)
    good = np.sort(final[calib & (y == 1)])
    threshold = min(0.5, float(good[int(MAX_LOSS * len(good))]))
    return {"views": [{k: v[k] for k in ("mean", "std", "w", "b", "scale")} for v in views], "w": w / 5, "b": b, "threshold": threshold}


def judge(model: dict | None, x: list[bytes], m: list[bytes]) -> tuple[np.ndarray, ...]:
    """text_score, meta_score, score and kept of packed views."""
    n = len(x)
    if model is None or not n:
        half = np.full(n, 0.5)
        return half, half, half, np.full(n, True)
    z = [v["scale"][0] * (((_matrix(a, len(v["mean"])) - v["mean"]) / v["std"]) @ v["w"] + v["b"]) + v["scale"][1] for a, v in zip((x, m), model["views"], strict=True)]
    score = sigmoid(z[0] * model["w"][0] + z[1] * model["w"][1] + model["b"])
    return sigmoid(z[0]), sigmoid(z[1]), score, score >= model["threshold"]


def _score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array(c) for c in judge(model, b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """text_score, meta_score, score and kept of every row of docs."""
    spark = docs.sparkSession
    set_batches(spark)
    with scratch(spark) as keep:
        table = keep(views_of(docs))
        model = fit(table, labels, label, labelled)
    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", "x", "m").mapInArrow(_score(model), f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    set_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        model = fit(views_of(docs), labels, label)

    def kept(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.array(judge(model, *_views(utf8(text), lang.to_pylist(), source.to_pylist(), n_chars.to_pylist()))[3], pa.bool_())

    kept.__annotations__ = dict.fromkeys(("text", "lang", "source", "n_chars", "return"), pa.Array)
    n = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    verdict = F.arrow_udf(kept, "boolean")(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), n.cast("long"))
    return docs.where(verdict)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
