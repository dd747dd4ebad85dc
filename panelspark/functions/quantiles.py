"""Quantiles and tails of the normal, t, chi-square and F families, in plain Python.

They are evaluated once for each distinct argument of an aggregated table, through vectorised functions at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * scale)
    # The continued fraction of the upper tail, by Lentz's method.
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or _TINY)
        c = (b + an / c) or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - scale * h)


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or _TINY)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or _TINY)
            c = (1 + top / c) or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def t_cdf(t: float, df: float) -> float:
    tail = beta_share(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def chi2_cdf(x: float, df: float) -> float:
    return gamma_share(df / 2, x / 2)


def _invert(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        if cdf(middle) < p:
            low = middle
        else:
            high = middle
        if high - low <= 1e-14 * max(1.0, abs(high)):
            break
    return (low + high) / 2


@lru_cache(100_000)
def t_quantile(p: float, df: float) -> float:
    """For p above one half, negated below."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    return _invert(lambda x: t_cdf(x, df), p, 0.0, 2.0)


@lru_cache(100_000)
def chi2_quantile(p: float, df: float) -> float:
    return _invert(lambda x: chi2_cdf(x, df), p, 0.0, max(4.0, df)) if p > 0 else 0.0


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_t(t: float, df: float) -> float:
    """The p-value of a t statistic."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def poisson_bounds(count: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval of a Poisson count."""
    alpha = 1 - level
    low = chi2_quantile(alpha / 2, 2 * count) / 2 if count > 0 else 0.0
    return low, chi2_quantile(1 - alpha / 2, 2 * (count + 1)) / 2


@F.pandas_udf(T.DoubleType())  # a type object: a type in text needs a session when the module is loaded
def t975(df: pd.Series) -> pd.Series:
    """t(0.975) of a column of degrees of freedom; null where there are none."""
    return df.map(lambda d: t_quantile(0.975, float(d)) if d is not None and d >= 1 else None).astype(float)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([two_sided_t(float(a), float(b)) if a == a and b == b and b >= 1 else None for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def poisson_interval(count: pd.Series) -> pd.DataFrame:
    """The exact 95 % interval of each count."""
    found = [poisson_bounds(int(c)) if c == c and c is not None and c >= 0 else (None, None) for c in count]
    return pd.DataFrame(found, columns=["low", "high"], dtype=float)
