"""Whitening, compression bands and ranked search against brute force, and their edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lineguard.llm import bitsliced, compression, queries, whitening
from lineguard.llm.common import load

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# -- whitening


def _usable(rows):
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [k for k, _ in good], np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in good], dtype=object)


def _check(got, rows, components):
    keys, x = _usable(rows)
    n, s = len(x), x.sum(axis=0)
    far = {k: int(v) for k, v in zip(keys, ((n * x - s) ** 2).sum(axis=1))}
    y = x.astype(float) - (s / n).astype(float)
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = y @ vectors[:, :components] / np.sqrt(values[:components])
    own = {}
    for r in got:
        own.setdefault(r["vec_id"], {})[r["component"]] = r
        assert (r["n"], int(r["deviation"])) == (n, far[r["vec_id"]])
        assert r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
    assert set(own) == set(keys)
    w = np.array([[own[k][j + 1]["whitened"] for j in range(components)] for k in keys])
    sign = np.sign((w * z).sum(axis=0))
    assert np.abs(w * sign - z).max() < 1e-6


def test_whitening_query_equals_a_plain_decomposition(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in load(spark, SF, "embeddings").collect()]
    got = queries.op11_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    _check(got.collect(), rows, 8)


def test_whitening_with_clear_gaps_and_exact_large_deviations(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 30)) * np.geomspace(900, 0.5, 30) + 3e5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    _check(whitening.whiten(df, components=5).collect(), rows, 5)


def test_whitening_ends_where_eigenvalues_are_equal(spark):
    # Unit vectors and their negatives: all 40 eigenvalues are the same.
    eye = np.eye(40)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.vstack([eye, -eye]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 80 * 8 and max(r["identity_error"] for r in got) < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (2, [1.5, -1.0]), (None, [0.25, 3.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]), (6, []), (7, [1.0])]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], "vec_id long, embedding array<double>, n long, component string, k string")
    df = df.unionByName(spark.createDataFrame([(8, [None, 1.0], 1, "a", "b"), (9, [1e30, 1.0], 1, "a", "b")], df.schema))
    got = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2}
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["deviation"] == 0 for r in same)
    assert whitening.whiten(df.limit(0)).collect() == []


# -- compression bands


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def _kept(text):
    body = (text or "").encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    low, high = [b[1:] for b in compression.BANDS if b[0] <= len(body)][-1]
    chunks = [ratio(body[i : i + 4096]) for i in range(0, len(body), 4096) if len(body) - i >= 4096]
    outside = sum(1 for r in chunks if r < compression.CHUNK_BAND[0] or r > compression.CHUNK_BAND[1])
    return not _base(text)[5] and low <= (ratio(body) if body else 0) <= high and outside * 5 <= len(chunks)


def _prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    return " ".join(words[min(int(rng.expovariate(0.006)), 899)] for _ in range(n))


def _odd_texts():
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = " ".join("".join(rng.choice(letters) for _ in range(60)) for _ in range(400))
    # Each line differs from all others, so that no window of three words repeats while the text says the same again.
    numbered = "\n".join(f"line{i} of{i} the{i} listing{i} that{i} says{i} nothing{i} new{i}" for i in range(3000))
    clean = _prose(1, 3000)
    return {
        "null": None, "empty": "", "spaces": " \n\t ", "short": "a b c", "clean": clean, "clean again": clean, "noise": noise, "numbered": numbered,
        "half noise": clean + " " + noise, "lines": "one two\n\none two\n  \none two\nx", "repeated": "a b c d " * 50, "marks": "#a *b $$ <c> é\x85x y " * 3, "long": _prose(2, 400_000),
    }


def test_compression_against_brute_force(spark):
    texts = _odd_texts()
    df = spark.createDataFrame([(n, t, 1, True) for n, t in texts.items()], "doc_id string, text string, n_words int, kept boolean")
    got = {r["doc_id"]: r["j"] for r in df.select("doc_id", compression.judge(F.col("text")).alias("j")).collect()}
    for name, t in texts.items():
        r = got[name]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(t), name
        assert r["kept"] == _kept(t), name
    assert [n for n in texts if got[n]["kept"]] == ["clean", "clean again", "long"]
    assert not got["half noise"]["base_failed"] and not got["numbered"]["base_failed"] and not got["noise"]["base_failed"]
    assert df.limit(0).select(compression.judge(F.col("text"))).collect() == []


def test_compression_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in load(spark, SF, "documents").collect()}
    rows = queries.op12_compression(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(texts[r["doc_id"]])
        assert r["kept"] == _kept(texts[r["doc_id"]])


# -- ranked search


def _words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]


def _ranking(docs, items, found=10):
    counted = [(d, Counter(_words(t))) for d, t in docs]
    full = [(d, c) for d, c in counted if c]
    n_docs, tokens = len(full), sum(sum(c.values()) for _, c in full)
    out = []
    for i, t in items:
        scores = []
        for d, c in full:
            m, score = 25 + (75 * sum(c.values()) * n_docs) // tokens, 0
            for w, q in Counter(_words(t)).items():
                df = sum(1 for _, o in full if w in o)
                if c[w]:
                    score += q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(i, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(scores)[:found])]
    return sorted(out, key=repr)


def _rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def _corpus():
    rng = random.Random(9)
    common, rare = [f"w{i}" for i in range(30)], [f"R{i}é" for i in range(300)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(n))
    docs = [(i, text(rng.randint(1, 120))) for i in range(150)]
    copy = text(60)
    docs += [(1000 + i, copy) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, copy), (None, None), (2000, ""), (2001, "-- !"), (2002, text(60_000)), (2003, "w1 " * 5000)]
    items = [(i, text(25)) for i in range(12)] + [(50, copy), (50, copy), (None, "w1 R2é"), (51, None), (52, "unknown"), (53, "W1 w1 w1"), (54, text(4000))]
    return docs, items


def test_search_against_brute_force(spark, monkeypatch):
    docs, items = _corpus()
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, k int, score string, item int").repartition(5)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, rank string")
    want = _ranking(docs, items)
    assert _rows(bitsliced.search(d, q)) == want
    monkeypatch.setattr(bitsliced, "ITEMS", 4)
    monkeypatch.setattr(bitsliced, "BLOCK_DOCS", 16)
    assert _rows(bitsliced.search(d, q)) == want
    assert _rows(bitsliced.search(d.limit(0), q)) == [] and _rows(bitsliced.search(d, q.limit(0))) == []


def test_bounds_are_never_below_the_score():
    docs, items = _corpus()
    found = bitsliced.Queries([t for _, t in items])
    counted = [Counter(bitsliced.terms(t)) for _, t in docs]
    full = [(t, c) for (_, t), c in zip(docs, counted) if c]
    df = Counter(w for _, c in full for w in c)
    found.weigh(len(full), sum(sum(c.values()) for _, c in full), {i: df[w] for i, w in enumerate(found.words) if df[w]})
    bounds = bitsliced.Bounds(found)
    for t, c in full:
        n, width, h, level = bitsliced._signature(t)
        w, _, lengths, slices = bitsliced._block(width, [(0, n, h, level)])
        upper = bounds.of(w, np.array(lengths), slices)[:, 0]
        exact = [found.score(k, c, found.lengthening(n)) for k in range(len(items))]
        assert (upper >= exact).all()
