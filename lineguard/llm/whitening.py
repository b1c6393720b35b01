"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. One pass over the vectors applies it to a block of a few columns: each task sums its
centred ``Yᵀ(YQ)``. A polynomial of such passes damps the part of the spectrum that is not wanted, QR makes the block
orthonormal again and Rayleigh-Ritz turns it to the eigenvectors, until their residuals certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineguard.llm.common import stage

COMPONENTS = 8
#: Columns that are iterated beyond those wanted; they set the border of the damped part.
GUARD = 8
#: Passes of one filter.
DEGREE = 8
#: Residuals over the largest eigenvalue: certified at once, and certified when rounding lets them fall no further.
CERTIFIED, ROUNDING = 1e-14, 1e-11
#: Vectors of one packed row.
BLOCK = 2_048
SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact place in 64-bit sums; such vectors are left out like infinite ones.
LARGEST = 2.0**40
#: A component whose variance is below this share of the trace has none.
NO_VARIANCE = 1e-12

Batches = Iterator[pa.RecordBatch]


@dataclass
class Whitening:
    """What was fitted: *origin* + *rest* is the mean (its whole and its broken part), *vectors* are columns."""

    n: int
    sums: list[int]
    origin: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    dims = batch.column("dims").to_numpy()
    for k, cell in enumerate(batch.column("x")):
        yield np.frombuffer(cell.as_buffer(), dtype="<i8").reshape(-1, int(dims[k]))


def _centred(rows: np.ndarray, origin: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (rows - origin).astype(np.float64) - rest


def packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``keys, x, dims``: the usable vectors as whole numbers, up to ``BLOCK`` to a row.

    Vectors that are null, hold a null, non-finite or too large entry, or have another length than most
    (the longer of two equally frequent lengths) are left out.
    """
    v = F.col("v")
    given = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    x = F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    whole = given.where(sound).select("k", x.alias("x"))
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = lengths[0]["d"] if lengths else 1
    kind = df.schema[key].dataType

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, BLOCK):
                keys = batch.column("k").slice(lo, BLOCK)
                body = flat[lo * dims : (lo + len(keys)) * dims].astype("<i8").tobytes()
                column = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.concat_arrays([keys]))
                yield pa.RecordBatch.from_arrays([column, pa.array([body], pa.binary()), pa.array([dims], pa.int32())], ["keys", "x", "dims"])

    out = T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("x", T.BinaryType()), T.StructField("dims", T.IntegerType())])
    return stage(whole.where(F.size("x") == dims).mapInArrow(pack, out), "vector-blocks")


def _summed(blocks: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of *part* over all blocks of vectors: one partial sum per task, added by position on the executors."""

    def sums(batches: Batches) -> Batches:
        total = np.zeros(shape)
        for batch in batches:
            for rows in _rows(batch):
                total += part(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], ["at", "value"])

    found = blocks.select("x", "dims").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(int(np.prod(shape)))
    for r in found.collect():
        out[r["at"]] = r["value"]
    return out.reshape(shape)


def _totals(blocks: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def sums(batches: Batches) -> Batches:
        n, total = 0, None
        for batch in batches:
            for rows in _rows(batch):
                part = rows.sum(axis=0).astype(object)
                n, total = n + len(rows), part if total is None else total + part
        values = [] if total is None else [n, *total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int64()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["at", "value"]
        )

    found = blocks.select("x", "dims").mapInArrow(sums, "at long, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    values = [int(r["value"]) for r in found.orderBy("at").collect()]
    return (values[0], values[1:]) if values else (0, [])


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of *q*: values falling, vectors, and the covariance applied to them."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def _filter(apply: Callable, q: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance on *q*: at most about 1 in size on [low, high], 1 at *top*, growing between."""
    centre, half = (high + low) / 2, max((high - low) / 2, 1e-300)
    sigma = half / (top - centre)
    first, before = sigma, q
    now = (apply(q) - centre * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def fit(blocks: DataFrame, components: int = COMPONENTS, seed: int = 1) -> Whitening | None:
    """Mean, leading eigenvalues and eigenvectors of the covariance of *blocks* (see :func:`packed`); None without vectors.

    The driver holds matrices of (dimensions x block columns) only. A block that converges slowly, as several
    eigenvalues lie at its border, is doubled; a block of all dimensions is exact, so the iteration ends.
    """
    n, sums = _totals(blocks)
    if not n:
        return None
    d = len(sums)
    origin = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    trace = float(_summed(blocks, (1,), lambda rows: np.array([(_centred(rows, origin, rest) ** 2).sum()]))[0]) / n
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(rows: np.ndarray) -> np.ndarray:
            y = _centred(rows, origin, rest)
            return y.T @ (y @ q)

        return _summed(blocks, q.shape, part) / n

    wanted, width = min(components, d), min(components + GUARD, d)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    vq = apply(q)
    values, q, vq = _ritz(q, vq)
    low = 0.0
    if 2 * width < d:
        # A second block of the Krylov space shows how far down the spectrum reaches.
        more = np.linalg.qr(vq - q @ (q.T @ vq))[0]
        more = np.linalg.qr(more - q @ (q.T @ more))[0]
        both, applied = np.hstack([q, more]), np.hstack([vq, apply(more)])
        values, both, applied = _ritz(both, applied)
        low = max(0.0, values[-1] - np.linalg.norm(applied[:, -1] - values[-1] * both[:, -1]))
        values, q, vq = values[:width], both[:, :width], applied[:, :width]
    last = np.inf
    while True:
        top = max(values[0], 1e-300)
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / top)
        if residual <= CERTIFIED or width == d or (residual <= ROUNDING and residual > last / 2):
            break
        if residual > last / 4:
            low, width = 0.0, min(2 * width, d)
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, width - q.shape[1]))]))[0]
            last = np.inf
        else:
            q, last = np.linalg.qr(_filter(apply, q, min(low, values[-1] * 0.999), values[-1], top))[0], residual
        values, q, vq = _ritz(q, apply(q))
    return Whitening(n, sums, origin, rest, np.maximum(values[:wanted], 0.0), q[:, :wanted], trace, residual, passes)


def _projection(w: Whitening) -> np.ndarray:
    """Columns that whiten: eigenvectors over the root of their eigenvalues, nothing where there is no variance."""
    some = w.values > NO_VARIANCE * w.trace
    return w.vectors * np.where(some, 1 / np.sqrt(np.where(some, w.values, 1.0)), np.nan)


def identity_error(blocks: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured in one pass.

    Components without variance do not count; with none left it is 0.
    """
    p = _projection(w)
    p = p[:, ~np.isnan(p[0])]
    if not p.size:
        return 0.0

    def part(rows: np.ndarray) -> np.ndarray:
        z = _centred(rows, w.origin, w.rest) @ p
        return np.vstack([z.T @ z, z.sum(axis=0)])

    k = p.shape[1]
    sums = _summed(blocks, (k + 1, k), part) / w.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def _deviations(rows: np.ndarray, w: Whitening) -> list[int]:
    """Per vector the sum over its dimensions of (n x - S)^2, exact at any size."""
    y = rows - w.origin
    rest = np.array([s % w.n for s in w.sums], dtype=object)
    size = int(np.abs(y).max(initial=0)) + 1
    if (w.n * size) ** 2 * rows.shape[1] < 2**63:
        return ((y * w.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return ((y.astype(object) * w.n - rest) ** 2).sum(axis=1).tolist()


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``<key>, component, n, deviation, whitened, explained, identity_error`` per usable vector and component.

    Vectors that are null, empty, or hold a null, non-finite or too large entry (2^40 or more) have no rows, neither have those of
    another length than most. Repeated rows and null keys are vectors like others. There are as many components as dimensions if those
    are fewer; a component without variance has null as ``whitened``. An empty table gives an empty result. ``deviation``
    is a whole number of any size: ``decimal(38, 0)``, null beyond that. Other columns of *df* play no part.
    """
    kind = df.schema[key].dataType
    blocks = packed(df, key, vector)
    w = fit(blocks, components)
    error = identity_error(blocks, w) if w else 0.0
    out = T.StructType([T.StructField("k", kind), *T.StructType.fromDDL("component int, deviation decimal(38,0), whitened double, explained double")])
    share = w.values / w.trace if w and w.trace > 0 else np.zeros(components)
    projection = _projection(w) if w else None

    def rows_of(batches: Batches) -> Batches:
        for batch in batches:
            for k, rows in enumerate(_rows(batch)):
                z = _centred(rows, w.origin, w.rest) @ projection
                count, width = z.shape
                keys = batch.column("keys")[k].values
                far = [Decimal(v) if v < 10**38 else None for v in _deviations(rows, w)]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(np.repeat(np.arange(count), width))),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                        pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(count), width))),
                        pa.array(z.ravel(), from_pandas=True),
                        pa.array(np.tile(share[:width], count)),
                    ],
                    ["k", "component", "deviation", "whitened", "explained"],
                )

    found = blocks.mapInArrow(rows_of, out)
    return found.select(
        F.col("k").alias(key), "component", F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )
