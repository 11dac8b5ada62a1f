"""Toxicity of deobfuscated text by a noisy channel.

Words that look disguised - letters mixed with digits or signs that stand for letters, letters drawn out three
times or more, single letters spelled with spaces or signs between - become lattices: every character may be read
as the letters it can stand for, and a drawn-out letter once or twice; signs that end a word also as what they are,
a separator between spelled letters also as the end of a word. Viterbi decoding picks the reading that a
character trigram model with the channel's costs finds likeliest. The model is counted over all documents. Lattices
of any length are decoded, in time and memory in proportion to their length.

The restored text is scored by a logistic regression on hashed words and word beginnings. Which of them it
uses, and their weights, come from at most LABELLED labelled documents of at most SAMPLE_CHARS characters, chosen
by a hash of the id, and never from rows with crc32(doc_id) mod 4 = 2. Scores are calibrated on what models of other folds
say of each row.
Labels, language, source and id are no inputs.

Nulls and empty texts score as texts without words do. An empty table gives an empty result; without labels of
both kinds all scores are the share of toxic labels. Rows that repeat score alike. Only doc_id and text are
read, texts whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm import common
from impactspark.llm.common import arrow_rows, mix64, set_batches, utf8, word_hashes
from impactspark.llm.linear import fit_sparse, platt, sigmoid
from impactspark.llm.quality_classifier import sample

LABELLED, SAMPLE_CHARS = 8_000, 200_000
#: Features at most; and never more than one for each document learned from.
FEATURES, MIN_SUPPORT = 1_024, 4
#: The penalty on weights, over the number of documents; folds for calibration.
L2, FOLDS = 0.3, 4
#: Bytes of word beginnings that are features, beside whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3

# the alphabet of the character model: 0 is any other character, then a-z and the letters of Latin-1 and Extended-A
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c == c.lower())
_N = 128
_SYMBOL = np.zeros(0x180, np.int64)
for _i, _c in enumerate(_LETTERS[: _N - 1]):
    _SYMBOL[ord(_c)] = _i + 1
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x180:
        _SYMBOL[ord(_c.upper())] = _i + 1

#: What a character may stand for, and what reading it so costs in nats.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "%": "x"}
LEET_COST, DOUBLE_COST = 0.7, 1.0
#: Reading the first sign that ends a word as what it is, an exclamation mark or another, and each further one; reading
#: a separator between spelled letters as the end of a word.
MARK_COST, SIGN_COST, MORE_COST, BREAK_COST = 1.0, 3.0, 1.0, 1.0
#: Decoded words of at most this many bytes are remembered.
MAX_SEEN = 256
_SEPARATORS = b".-_*~"
_BETWEEN = " .-_~*"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_ASCII = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHA = _ASCII.copy()
_ALPHA[0x80:] = True
_CODE = _table("".join(LEET).encode())
_SEP = _table(_SEPARATORS)
_GAP = common._IS_SPACE
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLAIN = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c in b" \n" else 32 for c in range(256)), np.uint8)


def suspects(t: bytes) -> list[tuple[int, int]]:
    """Byte ranges of what may be disguised, in order and apart from each other."""
    b = np.frombuffer(t, np.uint8)
    n = len(b)
    if n < 3:
        return []
    alpha, gap = _ALPHA[b], _GAP[b]
    hits = []
    code = _CODE[b]
    if code.any():
        # a sign between letters, in a run of signs of at most three
        at = np.flatnonzero(code[1:-1] & alpha[:-2]) + 1
        for i in at.tolist():
            j = i
            while j < n and j - i < 4 and code[j]:
                j += 1
            if j < n and alpha[j]:
                hits.append(i)
        # a sign that begins a word and goes on with a letter
        hits += (np.flatnonzero(code[:-1] & alpha[1:] & np.concatenate([[True], gap[:-2]])) + 0).tolist()
    out = []
    if code.any():
        # signs that end a run of letters and signs
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = alpha | code
        edge = np.flatnonzero(np.diff(inside))
        start, end = edge[0::2], edge[1::2]
        letters = np.concatenate([[0], np.cumsum(alpha)])
        ends = code[end - 1] & (letters[end] > letters[start]) & (end - start >= 3)
        out = list(zip(start[ends].tolist(), end[ends].tolist(), strict=True))
    low = b | np.uint8(0x20)
    hits += np.flatnonzero((low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & _ASCII[b[:-2]]).tolist()
    words: list[tuple[int, int]] = []
    for i in sorted(hits):
        if words and i < words[-1][1]:
            continue
        s, e = i, i
        while s > 0 and not gap[s - 1]:
            s -= 1
        while e < n and not gap[e]:
            e += 1
        while s < e and not alpha[s] and not code[s]:
            s += 1
        while e > s and not alpha[e - 1] and not code[e - 1]:
            e -= 1
        if e - s >= 3:
            words.append((s, e))
    out += words
    # single letters with single signs or spaces between: x.y.z or x y z
    sep = _SEP[b] | (b == 32)
    one = _ALPHA[b] & (b < 128) | code & ~sep
    one[1:] &= ~(alpha[:-1] | code[:-1] & ~sep[:-1])
    one[:-1] &= ~(_ALPHA[b][1:] | code[1:] & ~sep[1:])
    link = np.zeros(n, bool)
    link[:-2] = one[:-2] & sep[1:-1] & one[2:]
    if np.count_nonzero(link) >= 3:
        i, at = 0, np.flatnonzero(link)
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] == at[j] + 2:
                j += 1
            if j - i >= 2 and any(97 <= c | 0x20 <= 122 for c in t[at[i] : at[j] + 3 : 2]):
                out.append((int(at[i]), int(at[j]) + 3))
            i = j + 1
    # of ranges that begin together the longest
    out.sort(key=lambda x: (x[0], -x[1]))
    apart: list[tuple[int, int]] = []
    for s, e in out:
        if not apart or s >= apart[-1][1]:
            apart.append((s, e))
    return apart


class Decoder:
    """Viterbi over the lattice of one disguised word."""

    def __init__(self, counts: np.ndarray):
        """counts: trigrams of the alphabet, as (index, n) columns."""
        order = np.argsort(counts[:, 0], kind="stable")
        self.keys, self.n = counts[order, 0].astype(np.int32), counts[order, 1].astype(np.int64)
        #: total of each pair of letters, of which there are 128^2
        self.total = np.zeros(_N * _N, np.int64)
        np.add.at(self.total, self.keys // _N, self.n)
        self.known: dict[int, float] = {}
        self.seen: dict[bytes, bytes] = {}

    def cost(self, a: int, b: int, c: int) -> float:
        k = (a * _N + b) * _N + c
        v = self.known.get(k)
        if v is None:
            i = int(np.searchsorted(self.keys, k))
            n = int(self.n[i]) if i < len(self.keys) and self.keys[i] == k else 0
            v = self.known[k] = -float(np.log((n + 0.05) / (int(self.total[a * _N + b]) + 0.05 * 32)))
        return v

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each place the readings (letters, cost); a run of one letter is one place."""
        chain = _chain(word)
        places: list[list[tuple[str, float]]] = []
        last = len(word)
        while not chain and last and word[last - 1] in LEET:
            last -= 1
        i = 0
        while i < len(word):
            c = word[i].lower()
            j = i + 1
            while j < len(word) and word[j].lower() == c:
                j += 1
            if chain and c in _BETWEEN:
                places.append([("", 0.0), (" ", BREAK_COST)])
            elif c in LEET:
                reads = [(x * k, LEET_COST * k) for x in LEET[c] for k in ({1, 2} if j - i > 1 else {1})]
                if i >= last:
                    reads.append((" " + word[i:j], (MORE_COST if i > last else MARK_COST if c == "!" else SIGN_COST) + MORE_COST * (j - i - 1)))
                places.append(reads if i else [*reads, ("", 2.0)])
            elif c.isalpha():
                places.append([(c, 0.0 if j - i == 1 else DOUBLE_COST), (c + c, 0.0 if j - i == 2 else DOUBLE_COST)] if j - i > 1 else [(c, 0.0)])
            else:
                places.append([("", 0.5)])
            i = j
        return places

    def decode(self, raw: bytes) -> bytes:
        got = self.seen.get(raw)
        if got is not None:
            return got
        word = raw.decode("utf-8", "ignore")
        out = self.read(self.lattice(word))[1].encode()
        stem = raw.rstrip("".join(LEET).encode())
        if stem != raw and out.replace(b" ", b"").endswith(raw[len(stem) :]) and not suspects(stem):
            out = raw  # a plain word, and its signs are what they are
        if len(self.seen) > 100_000:
            self.seen.clear()
        if len(raw) <= MAX_SEEN:
            self.seen[raw] = out
        return out

    def read(self, places: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """The cheapest reading of a lattice and its cost; of equal ones at the end, the first by its letters."""
        # by the last two letters: the cost, and what was read as links to what was read before
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for reads in places:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, before) in paths.items():
                for letters, extra in reads:
                    x, y, z = a, b, cost + extra
                    for c in letters:
                        s = int(_SYMBOL[ord(c)]) if ord(c) < 0x180 else 0
                        if s or y:
                            z += self.cost(x, y, s)
                        x, y = (y, s) if s else (0, 0)
                    if (x, y) not in new or z < new[x, y][0]:
                        new[x, y] = (z, (before, letters) if letters else before)
            paths = new
        ends = [(cost + (self.cost(a, b, 0) if b else 0.0), path) for (a, b), (cost, path) in paths.items()]
        least = min(cost for cost, _ in ends)
        return least, min(_joined(path) for cost, path in ends if cost == least)

    def restore(self, t: bytes) -> bytes:
        parts, at = [], 0
        for s, e in suspects(t):
            word = self.decode(t[s:e])
            if word == t[s:e]:
                continue
            parts += [t[at:s], b" ", word, b" "]
            at = e
        return b"".join([*parts, t[at:]]) if parts else t


def _split(word: str) -> list[str]:
    for c in _BETWEEN:
        word = word.replace(c, "\0")
    return [p for p in word.split("\0") if p]


def _chain(word: str) -> bool:
    """Single letters and signs with separators between."""
    return any(c in _BETWEEN for c in word) and sum(c.isalpha() for c in word) >= 2 and all(len(p) == 1 for p in _split(word))


def _joined(path: tuple) -> str:
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def features(t: bytes) -> tuple[np.ndarray, int]:
    """Hashes of the words and word beginnings of a restored text, repeats included, and the number of words."""
    buf = _PLAIN[np.frombuffer(t, np.uint8)]
    h, start, end = word_hashes(buf.tobytes())
    out = [h]
    length = end - start
    head = np.zeros(len(start), np.uint64)
    for i in range(max(PREFIXES)):
        use = length > i + 1
        start, length, head = start[use], length[use], head[use]
        head = head + common._TABLE[buf[start + i]] * common._POW[i]
        if i + 1 in PREFIXES:
            out.append(mix64(head + np.uint64(i + 1)))
    return np.concatenate(out), len(h)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    keys = np.zeros(0, np.int64)
    for b in arrow_rows(batches):
        parts = []
        for t in b.column(0).to_pylist():
            if t:
                before = [0, 0]  # two boundaries before the first letter, as the decoder starts
                for k in range(0, len(t), common.CHUNK):
                    c = np.frombuffer(t[k : k + common.CHUNK].encode("utf-32-le"), np.uint32)
                    s = np.where(c < 0x180, _SYMBOL[np.minimum(c, 0x17F)], 0)
                    s = np.concatenate([before, s, [0] if k + common.CHUNK >= len(t) else []]).astype(np.int64)
                    before = s[-2:]
                    at = np.flatnonzero((s[1:-1] > 0) | (s[2:] > 0))
                    first = np.where(s[1:-1][at] > 0, s[:-2][at], 0)
                    parts.append((first * _N + s[1:-1][at]) * _N + s[2:][at])
        if parts:
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, u]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([total, n])).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["k", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all documents: at most 128^3 keys, which is 34 MB; some ten thousand in practice."""
    counts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_trigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = counts.toPandas().sort_values("k")
    return got[["k", "n"]].to_numpy(np.int64).reshape(-1, 2)


def _vector(f: np.ndarray, n: int, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen features of a text and their values: log counts."""
    f = f[bits[(f >> np.uint64(44)).astype(np.int64)]]
    at = np.searchsorted(keys, f)
    at[at == len(keys)] = 0
    at = at[keys[at] == f] if len(keys) else at[:0]
    col, count = np.unique(at, return_counts=True)
    return col, np.log1p(count)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED) -> dict:
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = sample(texts.where(F.coalesce(F.char_length("text"), F.lit(0)) <= SAMPLE_CHARS), labels, label, labelled)
    decoder = Decoder(language_model(docs))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            u = [np.unique(features(decoder.restore(t or b""))[0], return_counts=True) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([k.tobytes() for k, _ in u], pa.binary()), pa.array([np.minimum(n, 65535).astype(np.uint16).tobytes() for _, n in u], pa.binary())], ["doc_id", "label", "f", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    prepared = common.save(rows.select("doc_id", "text", "label").mapInArrow(prepare, f"doc_id {kind}, label int, f binary, n binary"), "toxic")
    # which features: by their share among toxic and other rows, counted where the rows are
    y = prepared.groupBy("label").count().toPandas().set_index("label")["count"].to_dict()
    pos, neg = y.get(1, 0), y.get(0, 0)
    base = pos / max(1, pos + neg)
    model = {"decoder": decoder, "keys": np.empty(0, np.uint64), "w": np.empty(0), "b": 0.0, "scale": (0.0, float(np.log((base + 1e-3) / (1 - base + 1e-3))))}
    if not pos or not neg:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for want in (0, 1):
                f = [np.frombuffer(x, np.uint64) for x, z in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True) if z == want]
                if f:
                    k, n = np.unique(np.concatenate(f), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n * (want == 1)), pa.array(n * (want == 0))], ["k", "p", "q"])

    c = prepared.select("label", "f").mapInArrow(count, "k long, p long, q long").groupBy("k").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= MIN_SUPPORT)
    total = float(pos + neg)
    # chi-squared of presence against the label, both ways
    seen = F.col("p") + F.col("q")
    chi = total * (F.col("p") * neg - F.col("q") * pos) ** 2 / (seen * (total - seen + 1) * float(pos) * float(neg))
    keys = np.sort(np.array([r[0] for r in c.orderBy(chi.desc(), "k").limit(max(64, min(FEATURES, pos + neg))).select("k").collect()], np.int64).view(np.uint64))
    if not len(keys):
        common.drop_table(docs.sparkSession, prepared)
        return model
    bits = _bits(keys)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, vals = [], []
            for f, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                k, m = np.frombuffer(f, np.uint64), np.frombuffer(n, np.uint16)
                at = np.searchsorted(keys, k)
                at[at == len(keys)] = 0
                hit = keys[at] == k
                cols.append(at[hit].astype(np.int32))
                vals.append(np.log1p(m[hit].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["doc_id", "label", "cols", "vals"])

    got = prepared.mapInArrow(vectors, f"doc_id {kind}, label int, cols array<int>, vals array<float>").toPandas().sort_values("doc_id").reset_index(drop=True)
    common.drop_table(docs.sparkSession, prepared)
    y = got["label"].to_numpy()
    size = got["cols"].map(len).to_numpy()
    row = np.repeat(np.arange(len(got)), size)
    col = np.concatenate(got["cols"].to_list()).astype(np.int64)
    val = np.concatenate(got["vals"].to_list()).astype(float)

    def learn(rows: np.ndarray) -> np.ndarray:
        """Logits of all rows from a model of those given."""
        use = rows[row]
        place = np.cumsum(rows) - 1
        w, b = fit_sparse(place[row[use]], col[use], val[use], int(rows.sum()), len(keys), y[rows].astype(float), l2=L2 / rows.sum())
        model.update(w=w, b=b)
        return np.bincount(row, val * w[col], len(got)) + b

    fold = np.array([zlib.crc32(b"fold:%d" % int(i)) % FOLDS for i in got["doc_id"]])
    z = np.zeros(len(got))
    for k in range(FOLDS):
        if (fold != k).any():
            z[fold == k] = learn(fold != k)[fold == k]
    scale = platt(z, y)
    learn(np.ones(len(got), bool))
    return model | {"keys": keys, "bits": bits, "scale": scale}


def _bits(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys >> np.uint64(44)).astype(np.int64)] = True
    return out


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(model["keys"])
        for b in batches:
            z = []
            for t in utf8(b.column(1)):
                f, n = features(model["decoder"].restore(t or b""))
                col, val = _vector(f, n, model["keys"], bits)
                z.append(float(val @ model["w"][col]) + model["b"])
            score = sigmoid(model["scale"][0] * np.array(z) + model["scale"][1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id and score of every row of docs."""
    set_batches(docs.sparkSession)
    model = fit(docs, labels, label)
    model.pop("bits", None)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
