"""Percentile bootstrap intervals without resampling rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineguard import params
from lineguard.operators.metrics import confusion_counts, score_counts, score_rows
from lineguard.operators.ordered import cut_points, default_parts, null_safe_join, range_number
from lineguard.session import stage

CELL_BOOTSTRAP = ("f1", "recall", "precision", "accuracy")


def _draw_metrics(cells: np.ndarray, metric: str) -> np.ndarray:
    tp, fp, fn, tn = cells.T.astype(float)

    def safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    if metric == "accuracy":
        return safe(tp + tn, tp + fp + fn + tn)
    if metric == "precision":
        return safe(tp, tp + fp)
    if metric == "recall":
        return safe(tp, tp + fn)
    return safe(2 * tp, 2 * tp + fp + fn)


def bootstrap_cells(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    label: str,
    threshold: Column | float,
    metric: str = "f1",
    *,
    n_samples: int = params.BOOTSTRAP_SAMPLES,
    alpha: float = 0.05,
    seed: int = params.SEED,
) -> DataFrame:
    """``(by..., point, lo, hi, n_bootstrap)`` for a metric of the confusion cells.

    Resampling n rows with replacement changes the metric only through the four cells, and
    those follow a multinomial law. Drawing cells is thus the same bootstrap at a
    cost that does not depend on the number of rows. One-class draws are skipped.
    """
    if metric not in CELL_BOOTSTRAP:
        raise ValueError(f"{metric!r} is not a function of the confusion cells")
    by = list(by)
    cells = confusion_counts(df.where(F.col(label).isNotNull()), by, score, label, threshold)
    schema = T.StructType(
        [cells.schema[c] for c in by]
        + [T.StructField(c, T.DoubleType()) for c in ("point", "lo", "hi")]
        + [T.StructField("n_bootstrap", T.LongType())]
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, c) for c in by)
                seen = np.array([row.tp, row.fp, row.fn, row.tn], dtype=np.int64)
                n = int(seen.sum())
                point = lo = hi = None
                kept = 0
                if n and n_samples > 0:
                    point = float(_draw_metrics(seen[None, :], metric)[0])
                    rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
                    sample = rng.multinomial(n, seen / n, size=n_samples)
                    positives = sample[:, 0] + sample[:, 2]
                    sample = sample[(positives > 0) & (positives < n)]
                    kept = len(sample)
                    if kept:
                        ends = [100 * alpha / 2, 100 * (1 - alpha / 2)]
                        lo, hi = (float(v) for v in np.percentile(_draw_metrics(sample, metric), ends))
                out.append((*key, point, lo, hi, kept))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return cells.mapInPandas(draw, schema)


RANKED_BOOTSTRAP = ("roc_auc", "average_precision", "brier", *CELL_BOOTSTRAP)
#: Scores that are weighted at once.
_TOGETHER = 512


def _replicates(pos: np.ndarray, neg: np.ndarray, keys: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of some scores, one row each: column 0 has the counts, the others a Poisson draw of them per replicate.

    Each row draws from a counter-based stream of its own key, so weights depend on no batch or task.
    """
    out = np.empty((2, len(pos), n + 1))
    for i, (a, b, k) in enumerate(zip(pos, neg, keys)):
        rng = np.random.Generator(np.random.Philox(key=[int(k) & 0xFFFFFFFFFFFFFFFF, seed]))
        out[0, i, 0], out[1, i, 0] = a, b
        out[0, i, 1:], out[1, i, 1:] = rng.poisson(a, n), rng.poisson(b, n)
    return out[0], out[1]


class _RangeSums:
    """Vector-valued sums of one (group, range): an entry per replicate, scores added in rising order."""

    NAMES = ("pos", "neg", "won", "tp", "fp", "squares")

    def __init__(self, n: int, seed: int, threshold: float):
        self.n, self.seed, self.threshold = n, seed, threshold
        self.sums = {k: np.zeros(n + 1) for k in self.NAMES}

    def add(self, score: np.ndarray, pos: np.ndarray, neg: np.ndarray, keys: np.ndarray) -> None:
        p, q = _replicates(pos, neg, keys, self.n, self.seed)
        s = self.sums
        below = s["neg"] + np.cumsum(q, axis=0) - q / 2
        s["won"] += (p * below).sum(axis=0)
        s["pos"] += p.sum(axis=0)
        s["neg"] += q.sum(axis=0)
        hit = score >= self.threshold
        s["tp"] += p[hit].sum(axis=0)
        s["fp"] += q[hit].sum(axis=0)
        s["squares"] += ((score - 1.0) ** 2) @ p + (score**2) @ q


def _metric(name: str, s: dict[str, np.ndarray], found: np.ndarray | None) -> np.ndarray:
    """One value per replicate from a group's sums; NaN where only one class was drawn."""
    pos, neg = s["pos"], s["neg"]
    both = (pos > 0) & (neg > 0)
    one = np.where(both, pos * neg, 1.0)
    if name == "roc_auc":
        out = s["won"] / one
    elif name == "average_precision":
        out = found / np.where(both, pos, 1.0)
    elif name == "brier":
        out = s["squares"] / np.where(both, pos + neg, 1.0)
    else:
        out = _draw_metrics(np.stack([s["tp"], s["fp"], pos - s["tp"], neg - s["fp"]], axis=1), name)
    return np.where(both, out, np.nan)


def bootstrap_ranked(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    label: str,
    metric: str = "roc_auc",
    *,
    threshold: float = 0.5,
    n_samples: int = params.BOOTSTRAP_SAMPLES,
    alpha: float = 0.05,
    seed: int = params.SEED,
) -> DataFrame:
    """``(by..., point, lo, hi, n_bootstrap)`` for rank metrics too, by a Poisson bootstrap over score counts.

    A count of c equal rows gets a Poisson(c) weight, as if each row drew Poisson(1). The weights of all replicates
    are a vector that never leaves its task: scores are dealt to ranges once, each (group, range) is added up in
    score order to a few vectors, and only these are combined. Average precision takes a second pass, as precision
    in a range depends on all higher ranges. Replicates with one class are skipped; a group with one class has nulls.
    """
    if metric not in RANKED_BOOTSTRAP:
        raise ValueError(f"{metric!r} has no ranked bootstrap")
    by = list(by)
    counts = score_counts(df, by, score, label)
    cuts = cut_points(score_rows(df, score, label), ["score"], ["score"], default_parts(df))
    ranged = counts.select(*by, range_number(["score"], cuts).alias("_range"), "score", "pos", "neg", F.xxhash64(*by, "score").alias("_key"))
    key = [*by, "_range"]
    dealt = ranged.repartition(*key).sortWithinPartitions(*key, "score")
    keys_schema = [ranged.schema[c] for c in key]
    vector = T.ArrayType(T.DoubleType())
    sums_schema = T.StructType([*keys_schema, *[T.StructField(c, vector) for c in _RangeSums.NAMES]])

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, None
        row = lambda: _one_row([*at, *sums.sums.values()], sums_schema)
        for pdf in batches:
            for here, part in pdf.groupby(key, sort=False, dropna=False):
                if here != at and sums is not None and not _same(here, at):
                    yield row()
                    sums = None
                if sums is None:
                    at, sums = here, _RangeSums(n_samples, seed, threshold)
                for lo in range(0, len(part), _TOGETHER):
                    some = part.iloc[lo : lo + _TOGETHER]
                    sums.add(*(some[c].to_numpy() for c in ("score", "pos", "neg", "_key")))
        if sums is not None:
            yield row()

    per_range = dealt.mapInPandas(totals, sums_schema)
    found_schema = T.StructType([*keys_schema, T.StructField("found", vector)])
    if metric == "average_precision":
        above_schema = T.StructType([*keys_schema, T.StructField("tp_above", vector), T.StructField("fp_above", vector)])
        per_range = stage(per_range, "range-sums")

        def above(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_range", ascending=False)
            out = pdf[key].copy()
            for name, column in (("tp_above", "pos"), ("fp_above", "neg")):
                v = np.stack(pdf[column])
                out[name] = list(np.cumsum(v, axis=0) - v)
            return out

        def precision(own: pd.DataFrame, higher: pd.DataFrame) -> pd.DataFrame:
            tp, fp = (np.array(higher[c].iloc[0]) for c in ("tp_above", "fp_above"))
            found = np.zeros(n_samples + 1)
            own = own.sort_values("score", ascending=False)
            for lo in range(0, len(own), _TOGETHER):
                some = own.iloc[lo : lo + _TOGETHER]
                p, q = _replicates(some["pos"].to_numpy(), some["neg"].to_numpy(), some["_key"].to_numpy(), n_samples, seed)
                tp_here, fp_here = tp + np.cumsum(p, axis=0), fp + np.cumsum(q, axis=0)
                all_here = tp_here + fp_here
                found += (p * tp_here / np.where(all_here > 0, all_here, 1.0)).sum(axis=0)
                tp, fp = tp_here[-1], fp_here[-1]
            return _one_row([*higher[key].iloc[0], found], found_schema)

        offsets = per_range.groupBy(*by).applyInPandas(above, above_schema)
        found = ranged.groupBy(*key).cogroup(offsets.groupBy(*key)).applyInPandas(precision, found_schema)
        per_range = null_safe_join(per_range, found, key)
    out_schema = T.StructType(
        [ranged.schema[c] for c in by]
        + [T.StructField(c, T.DoubleType()) for c in ("point", "lo", "hi")]
        + [T.StructField("n_bootstrap", T.LongType())]
    )

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        # A row per range of the group: offsets of the ranges below turn pairs won inside into pairs won in all.
        pdf = pdf.sort_values("_range")
        v = {c: np.stack(pdf[c]) for c in _RangeSums.NAMES}
        below = np.cumsum(v["neg"], axis=0) - v["neg"]
        sums = {c: x.sum(axis=0) for c, x in v.items()}
        sums["won"] = (v["won"] + v["pos"] * below).sum(axis=0)
        found = np.stack(pdf["found"]).sum(axis=0) if "found" in pdf else None
        values = _metric(metric, sums, found)
        drawn = values[1:][~np.isnan(values[1:])]
        lo, hi = np.percentile(drawn, [100 * alpha / 2, 100 * (1 - alpha / 2)]) if len(drawn) else (None, None)
        point = None if np.isnan(values[0]) else values[0]
        return _one_row([*(pdf[c].iloc[0] for c in by), point, lo, hi, len(drawn)], out_schema)

    return per_range.groupBy(*by).applyInPandas(combine, out_schema)


def _one_row(values: list, schema: T.StructType) -> pd.DataFrame:
    """A frame of one row; a missing value of any kind is None."""
    cells = [None if np.ndim(v) == 0 and pd.isna(v) else v for v in values]
    return pd.DataFrame({name: pd.Series([v], dtype=object) for name, v in zip(schema.names, cells)})


def _same(a: tuple, b: tuple) -> bool:
    """Equal keys, missing values equal to each other."""
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))
