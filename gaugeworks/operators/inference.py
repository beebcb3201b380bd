"""Exact intervals and tails of final rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_beta_front(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of 1 / B(a, b)."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    return lgamma(a + b) - lgamma(a) - lgamma(b)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, front: np.ndarray, tolerance: float = 1e-14) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), all rows at once.

    The side on which the fraction converges fast is taken, so steps grow with the root of the larger parameter.
    """
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore", over="ignore"):
        head = np.exp(front + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, m = d.copy(), 1
    while True:
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            change = d * c
            h = h * change
        if np.all(np.abs(change - 1) < tolerance) or m > 100_000:
            break
        m += 1
    low = np.clip(head * h, 0.0, 1.0)
    return np.where(swap, 1 - low, low)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with beta_cdf(x) = p: Newton steps from the normal approximation, kept inside a bracket that each step narrows."""
    front = log_beta_front(a, b)
    center, spread = a / (a + b), np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    low, high = np.zeros_like(center), np.ones_like(center)
    x = np.clip(center + spread * np.where(p < 0.5, -1.96, 1.96), center * 1e-3, 1 - (1 - center) * 1e-3)
    for _ in range(100):
        f = beta_cdf(x, a, b, front) - p
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            step = x - f / np.exp(front + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(new - x) <= 1e-14 * np.maximum(new, 1e-300)):
            break
        x = new
    return x


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Exact binomial interval from beta quantiles; 0 below no success, 1 above no failure, null for nulls or k outside 0..n."""

    def bound(ks: pd.Series, ns: pd.Series, upper: bool) -> pd.Series:
        k, n = ks.to_numpy("f8", na_value=np.nan), ns.to_numpy("f8", na_value=np.nan)
        out = np.where((k >= 0) & (k <= n) & (n > 0), 1.0 if upper else 0.0, np.nan)
        inner = (out == out) & ((k < n) if upper else (k > 0))
        if inner.any():
            k, n = k[inner], n[inner]
            out[inner] = beta_quantile(np.full(len(k), 1 - alpha / 2), k + 1, n - k) if upper else beta_quantile(np.full(len(k), alpha / 2), k, n - k + 1)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    @F.pandas_udf("double")
    def lower(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return bound(ks, ns, False)

    @F.pandas_udf("double")
    def upper(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return bound(ks, ns, True)

    return lower(k, n), upper(k, n)


def normal_tail(z: Column) -> Column:
    """P(Z >= z) for a column of the few final rows."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2)))

    return tail(z)

