"""Near duplicates and repeated passages against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from edge import docs_frame, empty_docs, strange_docs

from impactspark.llm.common import components, grams, mix64, prefix_sums, word_hashes
from impactspark.llm.neardup import keep_one, near_duplicates, shingles, signature
from impactspark.llm.substrings import anchors, recompress, remove_repeats

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_components(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = words_of(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                ra, rb = root(ids[x]), root(ids[y])
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k] = f"x{rng.randrange(10**6)}"
    return out


def a_corpus(seed):
    rng = random.Random(seed)
    docs, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            t = " ".join(edited(rng, base, rng.randrange(max(1, len(base) // 25) + 1)))
            docs.append((n, t if rng.random() < 0.7 else t.upper()))
            n += rng.choice([1, 3])
    # a chain: each step near the last, the ends far apart
    chain = [f"c{k}" for k in range(200)]
    for k in range(8):
        chain = chain[:]
        chain[k * 20] = f"new{k}"
        chain[k * 20 + 9] = f"new{k}b"
        docs.append((1000 - k, " ".join(chain)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, crowd", [(1, 4096), (2, 4096), (1, 2), (3, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr("impactspark.llm.neardup.CROWD", crowd)
    docs = a_corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_frame(spark, docs)).collect()}
    assert got == plain_components(docs)


def test_near_duplicates_of_strange_rows(spark):
    docs = strange_docs(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        if r["doc_id"] in (3, 4, 5):
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (0, r["doc_id"], True)
        if r["doc_id"] in (8, 9):
            assert r["component_id"] == 8
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({r["doc_id"] for r in rows if r["doc_id"] is not None and r["kept"]})
    assert near_duplicates(empty_docs(spark)).count() == 0 and keep_one(empty_docs(spark)).count() == 0


def test_large_buckets_large_classes_and_chosen_rows(spark, monkeypatch):
    monkeypatch.setattr("impactspark.llm.neardup.CROWD", 4)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    family = [edited(rng, base, rng.choice([1, 2, 4, 8])) for _ in range(40)]
    docs = [(k, " ".join(w)) for k, w in enumerate(family)] + [(100 + k, "the same words in all of these documents") for k in range(60)] + [(200 + k, "") for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_frame(spark, docs)).collect()}
    assert got == plain_components(docs)
    rows = [(7, f"text number {k} " + "x " * 30, "en", f"s{k % 3}", k) for k in (5, 3, 4)] + [(8, None, "en", "s", 1), (8, "z " * 30, "en", "s", 1)] * 2
    for n in (1, 5):
        kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)).collect()
        assert sorted((r["doc_id"], str(r["text"])[:13], r["source"]) for r in kept) == [(7, "text number 3", "s0"), (8, "None", "s")]


def test_words_are_runs_of_other_bytes():
    text = "a\x1cb \x85 é\tü\n\n z\x0b\x0cq "
    data = text.encode()
    _, s, e = word_hashes(data)
    assert [data[i:j] for i, j in zip(s, e, strict=True)] == data.split()
    long = ("ab é" * 200_000).encode()
    h, s, e = word_hashes(long)
    assert [long[i:j] for i, j in zip(s[:2000], e[:2000], strict=True)] == long.split()[:2000] and len(h) == len(long.split())
    assert len(np.unique(h)) == len(set(long.split()))
    giant = b"x" * 1_000_000
    assert word_hashes(giant)[0][0] == word_hashes(b" " + giant + b" ")[0][0] and len(word_hashes(giant + b" y")[0]) == 2


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    off = []
    for _ in range(40):
        a, b = pool[:1000], np.concatenate([pool[150:1000], pool[2000:2150]])
        pool = rng.permutation(pool)
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        off.append((signature(np.unique(a)) == signature(np.unique(b))).mean() - truth)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_shingles_of_short_texts():
    assert len(shingles(None)) == len(shingles(b" \n")) == 0
    assert len(shingles(b"a b")) == 1 and shingles(b"A b")[0] == shingles(b"a  B")[0]
    assert len(shingles(b"a b c d e f")) == 2


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 900: 900, 901: 900}


def test_prefix_sums(spark):
    rows = [(g, k, k // 7, 1 + k % 3) for g in ("a", None) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, k int, bucket int, w long")
    got = {(r["g"], r["k"]): r["s"] for r in prefix_sums(df, ["g"], ["k"], "bucket", "w", "s").collect()}
    assert got == {(g, k): sum(1 + j % 3 for j in range(k)) for g in ("a", None) for k in range(40)}


def plain_repeats(docs):
    words = {i: words_of(t) for i, t in docs}
    first, out = {}, {}
    for i in sorted(words, key=lambda x: -1 if x is None else x):
        w, gone = words[i], [False] * len(words[i])
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if first.setdefault(k, (i, p)) != (i, p):
                gone[p : p + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [[f"p{rng.randrange(50)}" for _ in range(rng.choice([19, 20, 21, 35, 90]))] for _ in range(8)]
    docs = []
    for i in range(30):
        w = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.5:
                w += rng.choice(shared)
            elif kind < 0.65:
                w += [rng.choice("xy")] * rng.choice([2, 5, 19, 20, 21, 60])
            elif kind < 0.75:
                w += ["a", "b"] * rng.choice([5, 12, 30])
            else:
                w += [f"u{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        docs.append((i * 3 % 100, " ".join(w)))
    docs += [(200, docs[3][1]), (201, docs[3][1] + " "), (202, None), (203, "")]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    docs = passages(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs_frame(spark, docs)).collect()}
    assert got == plain_repeats(docs)


def test_repeats_in_strange_rows(spark):
    docs = strange_docs(spark)
    rows = remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["n_words"], r["n_removed"]))
    assert by[3] == by[4] == by[5] == {(0, 0)}
    assert len(by[6]) == 1
    assert by[8] == {(60, 0)} or by[8] == {(60, 60)}
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_equal_windows_choose_equal_places():
    rng = np.random.default_rng(4)
    for trial in range(600):
        window = rng.integers(0, (6, 50, 3)[trial % 3], 20).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if (window[2:] == window[1:-1])[(window[1:-1] == window[:-2])].any():
            continue
        names = set()
        for _ in range(6):
            left, right = (rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            h = np.concatenate([left, window, right])
            name, at, place = anchors(h)
            p = place[len(left)]
            names.add((int(p) - len(left), int(name[list(at).index(p)])) if p >= 0 else None)
        assert len(names) == 1


def test_recompression_names_runs_and_pairs_alike():
    a, b, c = (np.uint64(x * 0x9E3779B97F4A7C15 % 2**64) for x in (1, 2, 3))
    for s, at in recompress(np.array([a, a, a, b, c, a, a, a, b, c, a, a, a, b, c], np.uint64)):
        assert len(s) == len(at) < 15 and len(np.unique(s)) < len(s)
    assert len(grams(np.array([a]), 5)) == 0


def test_names_of_recompression_are_what_links_windows(monkeypatch):
    import impactspark.llm.substrings as substrings

    rng = np.random.default_rng(7)
    for words in (40, 10**6):
        h = mix64(rng.integers(0, words, 500).astype(np.uint64))
        name, at, place = anchors(h)
        whole = recompress(h)
        # other names of the second round, at the same starts, choose other places and link by other names
        for new in (np.zeros_like(whole[1][0]), whole[1][0] ^ np.uint64(0x5555555555555555)):
            monkeypatch.setattr(substrings, "recompress", lambda _, new=new, whole=whole: (whole[0], (new, whole[1][1])))
            other = anchors(h)
            # but for places with equal neighbours, which go by the first round
            left = set(other[0].tolist()) & set(name.tolist())
            assert not np.array_equal(other[2], place) and len(left) <= (len(name) / 2 if words == 40 else 0)
        # with fewer symbols there are fewer places
        monkeypatch.setattr(substrings, "recompress", lambda _, whole=whole: (whole[0], (whole[1][0][::2], whole[1][1][::2])))
        assert set(anchors(h)[1].tolist()) <= set(whole[1][1][::2].tolist())
        monkeypatch.undo()
