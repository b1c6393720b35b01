"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as two learned vectors, one of the word and one of its character n-grams. Windows of
``WINDOW`` words, each overlapping the next by half, cover the whole text; a document scores as its
highest window. Training picks, for each document, the window that scores highest so far.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lineguard.llm.common import sampled_rows, small_table

WINDOW = 32
STRIDE = 16
HIDDEN = 8
#: Sizes of the hashed tables and of their vectors; the first number of each vector starts as a log-odds.
WORDS, GRAMS, VECTOR = 1 << 18, 1 << 17, 4
GRAM_LENGTHS = (3, 4, 5)
#: Bound of the sample that the network is trained on, for each label.
PER_LABEL = 1_000
EPOCHS = 5
LEAST_STEPS = 100
_BATCH = 128
_RATE = 0.02
#: Windows that are scored at a time and words whose n-grams are looked up at a time: both bound the memory beside the
#: sample on the driver. Then the words whose numbers each worker keeps.
_WINDOWS = 512
_AT_ONCE = 4_096
CACHED_WORDS = 300_000
_WORD = re.compile(r"\w+")


def _gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of each word with its ends marked, word after word, and how many each has."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    slots, owners, mixed = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAM_LENGTHS) + 1):
        mixed = mixed[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        if n in GRAM_LENGTHS:
            inside = owner[: len(mixed)] == owner[n - 1 :]
            spread = (mixed[inside] ^ mixed[inside] >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
            slots.append((spread >> np.uint64(40)).astype(np.int64) % GRAMS)
            owners.append(owner[: len(mixed)][inside])
    owners = np.concatenate(owners)
    return np.concatenate(slots)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def _all_gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``_gram_slots`` of any number of words, some at a time, so that only the rows themselves grow with the words."""
    slots, per = [], []
    for lo in range(0, len(words), _AT_ONCE):
        found, n = _gram_slots(words[lo : lo + _AT_ONCE])
        slots.append(found.astype(np.int32))
        per.append(n)
    return np.concatenate(slots), np.concatenate(per)


def _word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), 1) % WORDS


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows(n: int) -> np.ndarray:
    """First words of the windows that cover *n* words; at least one window."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name: tables ``word`` and ``gram``; per direction ``W U b``; attention ``A v``; output ``o c``."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"word": 0.01 * scale(WORDS, VECTOR), "gram": 0.01 * scale(GRAMS, VECTOR)}
        for d in "fb":
            p |= {f"W{d}": scale(2 * VECTOR, 3 * HIDDEN), f"U{d}": scale(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"A": scale(2 * HIDDEN, HIDDEN), "v": scale(HIDDEN), "o": scale(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        return Network(p)

    def inputs(self, words: list[str]) -> np.ndarray:
        """The two vectors of each word, side by side."""
        if not words:
            return np.zeros((0, 2 * VECTOR), np.float32)
        slots, per = _gram_slots(words)
        return self._joined(np.array([_word_slot(w) for w in words]), slots, per)

    def _joined(self, word_slots: np.ndarray, gram_slots: np.ndarray, per: np.ndarray) -> np.ndarray:
        out, starts = np.zeros((len(per), 2 * VECTOR), np.float32), np.cumsum(per) - per
        out[:, :VECTOR] = self.p["word"][word_slots]
        for lo in range(0, len(per), _AT_ONCE):
            own, first = per[lo : lo + _AT_ONCE], starts[lo : lo + _AT_ONCE]
            found = self.p["gram"][gram_slots[first[0] : first[-1] + own[-1]]]
            out[lo : lo + len(own), VECTOR:] = np.add.reduceat(found, first - first[0], axis=0) / own[:, None]
        return out

    def _run(self, x: np.ndarray, real: np.ndarray, d: str, keep: bool):
        """States of one direction over ``x[time, window]``; where *real* is 0 the state stays."""
        p, h = self.p, np.zeros((x.shape[1], HIDDEN), np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        states, kept = np.zeros((len(x), x.shape[1], HIDDEN), np.float32), {}
        given = x.reshape(-1, x.shape[2]) @ p[f"W{d}"] + p[f"b{d}"]
        given = given.reshape(len(x), x.shape[1], 3 * HIDDEN)
        u_gates, u_new = np.ascontiguousarray(p[f"U{d}"][:, : 2 * HIDDEN]), np.ascontiguousarray(p[f"U{d}"][:, 2 * HIDDEN :])
        for t in steps:
            g = _sigmoid(given[t, :, : 2 * HIDDEN] + h @ u_gates)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            n = np.tanh(given[t, :, 2 * HIDDEN :] + (r * h) @ u_new)
            m = z * real[t][:, None]
            if keep:
                kept[t] = (h, z, r, n, m)
            h = h + m * (n - h)
            states[t] = h
        return states, kept

    def forward(self, x: np.ndarray, real: np.ndarray, keep: bool = False):
        """One logit per window; ``x[time, window, feature]``, ``real[time, window]``."""
        p = self.p
        fw, kf = self._run(x, real, "f", keep)
        bw, kb = self._run(x, real, "b", keep)
        s = np.concatenate((fw, bw), axis=2)
        a = np.tanh(s.reshape(-1, 2 * HIDDEN) @ p["A"]).reshape(*s.shape[:2], HIDDEN)
        e = np.where(real > 0, a @ p["v"], -30.0)
        w = np.exp(e - e.max(axis=0))
        w = (w / w.sum(axis=0)).astype(np.float32)
        pooled = (w[:, :, None] * s).sum(axis=0)
        logit = pooled @ p["o"] + p["c"]
        return logit, (s, a, w, pooled, kf, kb)

    def gradients(self, x: np.ndarray, real: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Of the weighted mean cross entropy: by parameter, and by input."""
        p = self.p
        logit, (s, a, w, pooled, kf, kb) = self.forward(x, real, keep=True)
        dl = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g = {"o": pooled.T @ dl, "c": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * p["o"]
        dw = (s * dp).sum(axis=2)
        ds = w[:, :, None] * dp
        de = w * (dw - (w * dw).sum(axis=0)) * (real > 0)
        g["v"] = (a * de[:, :, None]).sum(axis=(0, 1))
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = s.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, HIDDEN)
        ds = ds + da @ p["A"].T
        dx = np.zeros_like(x)
        for d, kept, part in (("f", kf, ds[:, :, :HIDDEN]), ("b", kb, ds[:, :, HIDDEN:])):
            u = p[f"U{d}"]
            gu, dgiven = np.zeros_like(u), np.zeros((len(x), x.shape[1], 3 * HIDDEN), np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                h, z, r, n, m = kept[t]
                dh = dh + part[t]
                dn = dh * m * (1 - n * n)
                dz = dh * (n - h) * real[t][:, None] * z * (1 - z)
                back = dn @ u[:, 2 * HIDDEN :].T
                dr = back * h * r * (1 - r)
                gates = np.concatenate((dz, dr), axis=1)
                gu[:, : 2 * HIDDEN] += h.T @ gates
                gu[:, 2 * HIDDEN :] += (r * h).T @ dn
                dgiven[t] = np.concatenate((gates, dn), axis=1)
                dh = dh * (1 - m) + back * r + gates @ u[:, : 2 * HIDDEN].T
            flat = dgiven.reshape(-1, 3 * HIDDEN)
            g |= {f"U{d}": gu, f"W{d}": x.reshape(-1, x.shape[2]).T @ flat, f"b{d}": flat.sum(axis=0)}
            dx += (flat @ p[f"W{d}"].T).reshape(x.shape)
        return g, dx


def _windows_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows, one row each and -1 beyond the end, and the document of each."""
    rows, owner = [], []
    for k, ids in enumerate(docs):
        starts = windows(len(ids))
        padded = np.concatenate((ids, np.full(starts[-1] + WINDOW, -1, ids.dtype)))[: starts[-1] + WINDOW]
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        owner.append(np.full(len(starts), k))
    return np.concatenate(rows), np.concatenate(owner)


def _odds(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the log-odds in each window, by which the first windows are chosen."""
    out = np.zeros(len(rows), np.float32)
    for lo in range(0, len(rows), _WINDOWS):
        part = rows[lo : lo + _WINDOWS]
        out[lo : lo + len(part)] = vectors[part, 0].sum(axis=1) + vectors[part, VECTOR].sum(axis=1)
    return out


def _logits(net: Network, vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """*vectors* holds the input of each word number and zeros in its last row."""
    out = np.zeros(len(rows), np.float32)
    for lo in range(0, len(rows), _WINDOWS):
        part = np.ascontiguousarray(rows[lo : lo + _WINDOWS].T)
        out[lo : lo + part.shape[1]] = net.forward(vectors[part], (part >= 0).astype(np.float32))[0]
    return out


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fits a network on documents marked 0 or 1; with one label only, every score is that label's."""
    net = Network.new(seed)
    p, y = net.p, np.array(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        p["o"][:] = 0
        p["c"][0] = 5.0 if labels and labels[0] else -5.0
        return net
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts]
    if not number:
        return net
    slots_w = np.array([_word_slot(w) for w in number])
    slots_g, per = _all_gram_slots(list(number))
    first_g = np.cumsum(per) - per

    def grams(ids: np.ndarray) -> np.ndarray:
        n = per[ids]
        return slots_g[np.repeat(first_g[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    for name, size, slots in (("word", WORDS, lambda i: slots_w[i]), ("gram", GRAMS, grams)):
        seen = np.zeros((2, size))
        for ids, label in zip(docs, labels):
            if len(ids):
                seen[label, np.unique(slots(np.unique(ids)))] += 1
        rate = (seen + 1) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 2)
        odds = np.log(rate[1] / rate[0]) * (seen.sum(axis=0) > 0)
        p[name][:, 0] = odds / 2
    rows, owner = _windows_of(docs)
    first_of = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    rng = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items() if k not in ("word", "gram")}
    squares = {k: np.full(p[k].shape, 1e-4, np.float32) for k in ("word", "gram")}
    weight = 1 / np.where(y == 1, y.mean(), 1 - y.mean())
    zero = np.zeros((1, 2 * VECTOR), np.float32)
    step = 0

    def inputs() -> np.ndarray:
        return np.concatenate((net._joined(slots_w, slots_g, per), zero))

    rounds = max(epochs, -(-LEAST_STEPS * _BATCH // len(docs)))
    for epoch in range(rounds):
        if epoch * epochs % rounds < epochs:  # the windows are chosen anew *epochs* times
            vectors = inputs()
            score = _odds(vectors, rows) if epoch == 0 else _logits(net, vectors, rows)
            best = np.lexsort((-score, owner))[first_of]
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), _BATCH):
            pick = order[lo : lo + _BATCH]
            part = np.ascontiguousarray(rows[best[pick]].T)
            distinct, back = np.unique(part, return_inverse=True)
            own = np.zeros((len(distinct), 2 * VECTOR), np.float32)
            known = distinct >= 0
            ids = distinct[known]
            flat = grams(ids)
            if len(ids):
                own[known] = net._joined(slots_w[ids], flat, per[ids])
            x = own[back.reshape(part.shape)]
            g, dx = net.gradients(x, (part >= 0).astype(np.float32), y[pick], weight[pick])
            step += 1
            rate = _RATE * min(1.0, step / 20)
            for k, (m1, m2) in moments.items():
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.01 * (g[k] ** 2 - m2)
                p[k] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            dv = np.zeros_like(own)
            np.add.at(dv, back.ravel(), dx.reshape(-1, 2 * VECTOR))
            if len(ids):
                spread = np.repeat(dv[known, VECTOR:] / per[ids][:, None], per[ids], axis=0)
                for k, at, d in (("word", slots_w[ids], dv[known, :VECTOR]), ("gram", flat, spread)):
                    where, back_at = np.unique(at, return_inverse=True)
                    total = np.zeros((len(where), VECTOR), np.float32)
                    np.add.at(total, back_at, d)
                    squares[k][where] += total**2
                    p[k][where] -= _RATE * total / np.sqrt(squares[k][where])
    p["c"] -= _threshold(_logits(net, inputs(), rows), first_of, y)
    return net


def _threshold(logit: np.ndarray, first_of: np.ndarray, y: np.ndarray) -> np.float32:
    """The logit in the widest gap among those that misjudge the fewest training documents."""
    top = np.maximum.reduceat(logit, first_of)
    order = np.argsort(top)
    value, label = top[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(label == 1))) + np.concatenate(([0], np.cumsum(label[::-1] == 0)))[::-1]
    ends = np.concatenate(([value[0] - 2], value, [value[-1] + 2]))
    gap = np.where(wrong == wrong.min(), np.diff(ends), -1.0)
    k = int(gap.argmax())
    return np.float32((ends[k] + ends[k + 1]) / 2)


class Scorer:
    """Scores whole texts; keeps the inputs of the words it has met, up to ``CACHED_WORDS``."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.vectors = np.zeros((1, 2 * VECTOR), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        if len(self.number) > CACHED_WORDS:
            self._clear()
        number, old = self.number, len(self.number)
        docs = [np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64) for ws in words]
        if len(number) > old:
            fresh = list(number)[old:]
            self.vectors = np.concatenate((self.vectors[:-1], self.net.inputs(fresh), self.vectors[-1:]))
        rows, owner = _windows_of(docs)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, _logits(self.net, self.vectors, rows))
        return _sigmoid(top.astype(np.float64))


def learn(docs: DataFrame, marks: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "toxic") -> Network:
    """Trains on at most ``PER_LABEL`` documents of each label, those of *marks* where *usable* holds.

    A document without a label, or with a null or other label, is not used; a null text counts as empty.
    Where a document is marked more than once, the highest mark counts; of documents that share an id, the least text.
    """
    marked = marks.where(F.col(mark_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marked = marked.agg(F.max(mark_col).cast("int").alias("mark"))
    picked = sampled_rows(marked.where(usable), F.col("mark"), PER_LABEL, F.col("id"))
    ids, given = pa.array([r["id"] for r in picked], pa.int64()), pa.array([r["mark"] for r in picked], pa.int32())
    chosen = small_table(docs.sparkSession, id=ids, mark=given)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = own.join(F.broadcast(chosen), "id").groupBy("id", "mark").agg(F.min("text").alias("text"))
    rows = found.collect()  # at most the sample
    rows = sorted(rows, key=lambda r: (r["id"], r["text"]))
    return train([r["text"] for r in rows], [r["mark"] for r in rows])


def score(net: Network, text: Column) -> Column:
    """The score of each whole text, 0 to 1; null and empty texts are one window without words."""
    scorer = []

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not scorer:
            scorer.append(Scorer(net))
        for batch in batches:
            out = []
            part, size = [], 0
            for k, t in enumerate(batch, 1):
                part.append(t)
                size += len(t or "")
                if size > 500_000 or k == len(batch):
                    out.append(scorer[0].scores(part))
                    part, size = [], 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return run(text)
