"""p-values for the drift tests, evaluated on result rows only.

These run on one row per (group, feature), after all aggregation, as Arrow
batches. Spark has no erf or Kolmogorov distribution to express them with.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: up to this sample size the exact two-sample distribution is used.
KS_EXACT_LIMIT = 10_000


def _ks_asymptotic(d: float, n: int, m: int) -> float:
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 0.04:  # the series needs many terms here and the value is 1 to 16 digits
        return 1.0
    if lam < 1.0:
        # Theta-function form, which converges fast for small arguments.
        k = np.arange(1, 40, 2)
        cdf = math.sqrt(2 * math.pi) / lam * np.exp(-((k * math.pi) ** 2) / (8 * lam * lam)).sum()
        return float(min(1.0, max(0.0, 1.0 - cdf)))
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * (k * lam) ** 2)).sum())))


def _ks_exact(d: float, n: int, m: int) -> float:
    """P(D >= d) by counting lattice paths that stay strictly inside the band."""
    n, m = max(n, m), min(n, m)
    g = math.gcd(n, m)
    lcm = n // g * m
    h = round(d * lcm)  # D is a multiple of 1 / lcm
    if h <= 0:
        return 1.0
    # Row j holds, for each i, the share of paths from (0, 0) to (i, j) that stay
    # inside |i/n - j/m| < d. Counts are kept relative to a running log scale.
    up, right = n // g, m // g
    width = np.arange(n + 1)
    row = (width * right < h).astype(float)
    log_scale = 0.0
    for j in range(1, m + 1):
        lo = max(0, (j * up - h) // right + 1)
        hi = min(n, -((-(j * up + h)) // right) - 1)
        fresh = np.zeros(n + 1)
        if lo > hi:
            return 1.0
        fresh[lo : hi + 1] = np.cumsum(row[lo : hi + 1])
        top = fresh.max()
        if top == 0.0:
            return 1.0
        row = fresh / top
        log_scale += math.log(top)
    if row[n] == 0.0:
        return 1.0
    log_inside = math.log(row[n]) + log_scale
    log_all = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return float(min(1.0, max(0.0, -math.expm1(log_inside - log_all))))


def ks_pvalue_value(d: float, n: int, m: int) -> float | None:
    if d is None or n is None or m is None or not math.isfinite(d) or min(n, m) < 2:
        return None
    if max(n, m) <= KS_EXACT_LIMIT:
        return _ks_exact(d, int(n), int(m))
    return _ks_asymptotic(d, int(n), int(m))


def chi2_sf_value(x: float, dof: int) -> float | None:
    """Upper tail of chi-square for an integer dof, in closed form."""
    if x is None or dof is None or not math.isfinite(x) or dof < 1:
        return None
    half = x / 2.0
    if half <= 0:
        return 1.0
    if dof % 2:
        total, term, k = math.erfc(math.sqrt(half)), None, 0.5
    else:
        total, term, k = math.exp(-half), None, 1.0
    # Q(a + 1, h) = Q(a, h) + h^a e^-h / Gamma(a + 1)
    while 2 * k < dof:
        total += math.exp(k * math.log(half) - half - math.lgamma(k + 1))
        k += 1.0
    return float(min(1.0, total))


@F.pandas_udf(T.DoubleType())
def ks_pvalue(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_pvalue_value(a, b, c) for a, b, c in zip(d, n, m)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_value(a, b) for a, b in zip(x, dof)], dtype="float64")
