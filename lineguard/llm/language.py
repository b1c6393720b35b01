"""Language identification by string kernels: presence of blended n-grams, Nyström landmarks, ridge regression.

The kernel of two texts is the number of distinct character n-grams of length 1 to ``LONGEST`` that both
hold, over the geometric mean of their own numbers. A few landmark texts give each text a short feature
vector (its kernels with them, whitened), on which one ridge regression per language is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lineguard.llm.common import sampled_rows

LONGEST = 3
#: Bounds of the sample that the model is fitted on and of its landmarks, whole texts of middling length.
PER_LANGUAGE = 600
LANDMARKS = 96
RIDGE = 1e-3
#: Distinct letters are kept in this many codes; 0 stands for everything that is no letter.
_CODES = 64
_ROWS = 256
NO_LETTER = "und"
_LETTER = regex.compile(r"\p{L}")


def codes(text: str) -> np.ndarray:
    """A code for each letter (case ignored), 0 for each run of others; a space stands at both ends.

    a to z have codes of their own, other letters share the remaining ones by code point.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    latin = (points >= 97) & (points <= 122)
    out = np.where(latin, points - 96, 0).astype(np.int64)
    beyond = np.flatnonzero(points >= 0xAA)
    if len(beyond):
        distinct, back = np.unique(points[beyond], return_inverse=True)
        letter = np.array([chr(p).isalpha() for p in distinct])
        own = np.where(letter, 27 + distinct % (_CODES - 27), 0)
        out[beyond] = own[back]
    keep = (out > 0) | np.concatenate(([True], out[:-1] > 0)) if len(out) else np.zeros(0, bool)
    return np.concatenate(([0], out[keep], [0]))


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of the whole text, as sorted integers."""
    c = codes(text or "")
    seen = np.zeros(_CODES + _CODES**2 + _CODES**3, dtype=bool)
    value, base = c, 0
    for n in range(1, LONGEST + 1):
        if n > 1:
            value = value[:-1] * _CODES + c[n - 1 :]
        if len(value):
            seen[base + value] = True
        base += _CODES**n
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: Column of each n-gram that a landmark holds, -1 for others.
    column: np.ndarray
    #: Which landmark holds which of them, over the square root of its number of n-grams.
    held: np.ndarray
    #: Landmark kernels to one score per language, and what is added.
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One row per text and one score per language, by products of whole batches."""
        out = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(texts), _ROWS):
            part = texts[lo : lo + _ROWS]
            out[lo : lo + len(part)] = _kernel(part, self.column, self.held) @ self.weights + self.bias
        return out


def _kernel(texts: list[str | None], column: np.ndarray, held: np.ndarray) -> np.ndarray:
    present = np.zeros((len(texts), held.shape[0]), dtype=np.float32)
    own = np.ones(len(texts))
    for k, text in enumerate(texts):
        g = grams(text)
        at = column[g]
        present[k, at[at >= 0]] = 1.0
        own[k] = max(1, len(g))
    return (present @ held).astype(np.float64) / np.sqrt(own)[:, None]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from ``(text, language)`` rows; the sample is the caller's, in any order."""
    rows = sorted(rows, key=lambda r: (r[1], len(r[0]), r[0]))
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model([], np.full(1, -1), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    of = {lang: [t for t, y in rows if y == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    chosen = [
        of[lang][i]
        for lang in languages
        for i in np.unique(np.linspace(len(of[lang]) // 4, 3 * len(of[lang]) // 4, each).astype(int))
    ]
    sets = [grams(t) for t in chosen]
    vocabulary = np.unique(np.concatenate(sets))
    column = np.full(_CODES + _CODES**2 + _CODES**3, -1, dtype=np.int32)
    column[vocabulary] = np.arange(len(vocabulary))
    held = np.zeros((len(vocabulary), len(sets)), dtype=np.float32)
    for k, g in enumerate(sets):
        held[column[g], k] = 1 / np.sqrt(len(g))
    among = _kernel(chosen, column, held)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])  # kernels with the landmarks to Nyström features
    model = Model(languages, column, held, whiten, np.zeros(whiten.shape[1]))
    texts = [t for t, _ in rows]
    features = np.concatenate([_kernel(texts[i : i + _ROWS], column, held) for i in range(0, len(texts), _ROWS)]) @ whiten
    target = np.where(np.array([[y == lang for lang in languages] for _, y in rows]), 1.0, -1.0)
    counts = np.array([len(of[y]) for _, y in rows])
    share = 1 / (len(languages) * counts)[:, None]  # each language weighs the same
    mean, goal = (features * share).sum(axis=0), (target * share).sum(axis=0)
    centred = features - mean
    normal = centred.T @ (centred * share) + ridge * np.eye(centred.shape[1])
    slope = np.linalg.solve(normal, centred.T @ ((target - goal) * share))
    return Model(model.languages, column, held, whiten @ slope, goal - mean @ slope)


def learn(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fits on at most ``PER_LANGUAGE`` rows of each language, those with a text and a language where *usable* holds."""
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    return fit([(r["text"], r["lang"]) for r in sampled_rows(rows, F.col("lang"), PER_LANGUAGE, F.col("id"), F.col("text"))])


def predict(model: Model, text: Column) -> Column:
    """A struct ``lang_pred, score`` for each whole text: the language of the highest score, and that score in 0 to 1.

    Null texts and texts without a letter are ``und`` with score 0; so are all if nothing was learned. Repeated rows
    are scored each, an empty table stays empty.
    """

    @pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch)
            ok = np.array([bool(t and model.languages and _LETTER.search(t)) for t in texts], dtype=bool)
            names, best = np.full(len(texts), NO_LETTER, dtype=object), np.zeros(len(texts))
            if ok.any():
                scores = model.scores([t for t, k in zip(texts, ok) if k])
                names[ok] = np.array(model.languages, dtype=object)[scores.argmax(axis=1)]
                best[ok] = np.clip((scores.max(axis=1) + 1) / 2, 0.0, 1.0)
            yield pd.DataFrame({"lang_pred": names, "score": best})

    return run.asNondeterministic()(text)  # or a filter on the result would repeat the scoring in workers of its own
