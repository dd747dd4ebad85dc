"""Curves and breaks in regressions, and weights of dimensions by their first component.

Only sums of products, as large as the number of terms, reach the driver; rows with a null are left out of a fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import correlation
from ..functions.quantiles import chi2_cdf
from .normalize import percentiles
from .stats import Fit, _dot, cross_products, ols_hc3

#: Quantiles at which knots stand, by their number.
KNOTS = {3: (0.1, 0.5, 0.9), 4: (0.05, 0.35, 0.65, 0.95), 5: (0.05, 0.275, 0.5, 0.725, 0.95)}


def spline_terms(x: Column, knots: Sequence[float]) -> list[Column]:
    """The terms beside x of a cubic spline that is a straight line beyond the first and last knot."""
    t = list(map(float, knots))
    plus = lambda k: F.pow(F.greatest(x - F.lit(t[k]), F.lit(0.0)), F.lit(3.0))
    wide, last = t[-1] - t[0], t[-1] - t[-2]
    return [(plus(j) - plus(-2) * ((t[-1] - t[j]) / last) + plus(-1) * ((t[-2] - t[j]) / last)) / wide**2 for j in range(len(t) - 2)]


def restricted_spline(df: DataFrame, y: str, x: str, knots: int = 4) -> tuple[Fit, list[float], dict[str, float]] | None:
    """y on a restricted cubic spline of x: the fit with HC3 errors, the knots (distinct exact quantiles of x) and a joint test of
    curvature (statistic, df, p). None where fewer than three knots differ."""
    rows = df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).na.drop()
    found = percentiles(rows, [x], KNOTS[knots]).first()
    at = sorted(set(found[f"_q_{x}"] or [])) if found else []
    if len(at) < 3:
        return None
    names = [f"{x}_{j}" for j in range(1, len(at) - 1)]
    fit = ols_hc3(rows, y, [x], dict(zip(names, spline_terms(F.col(x), at), strict=True)))
    own = [fit.names.index(n) for n in names]
    b = fit.coef[own]
    statistic = float(b @ np.linalg.solve(fit.cov[np.ix_(own, own)], b))
    return fit, at, {"statistic": statistic, "df": len(own), "p": float(1 - chi2_cdf(statistic, len(own)))}


def interrupted_series(df: DataFrame, y: str, entity: str, period: str, start: float, lags: int = 1) -> Fit:
    """const, trend, level and slope: the change of a series' level at `start` and of its slope from then on.

    Errors allow for correlation within an entity over so many periods, with weights that fall with the lag; each lag is a join of
    entities with themselves. A period is there once for each entity; gaps between periods are no neighbours.
    """
    rows = df.select(F.col(entity).alias("_e"), F.col(period).cast("long").alias("_t"), F.col(y).cast("double").alias("_y")).na.drop()
    late = (F.col("_t") >= start).cast("double")
    terms = [F.lit(1.0), F.col("_t") - F.lit(float(start)), late, (F.col("_t") - F.lit(float(start))) * late]
    k = len(terms)
    products = cross_products(rows, [*terms, F.col("_y")])
    n = int(products[0, 0])
    inverse = np.linalg.inv(products[:k, :k])
    coef = inverse @ products[:k, k]
    e = F.col("_y") - _dot(terms, coef)
    scores = rows.select("_e", "_t", *((c * e).alias(f"_u{i}") for i, c in enumerate(terms)))
    own = [F.col(f"_u{i}") for i in range(k)]
    meat = cross_products(scores, own)
    for lag in range(1, lags + 1):
        before = scores.select("_e", (F.col("_t") + lag).alias("_t"), *(F.col(f"_u{i}").alias(f"_v{i}") for i in range(k)))
        both = scores.join(before, ["_e", "_t"])
        crossed = both.agg(*(F.coalesce(F.sum(F.col(f"_u{i}") * F.col(f"_v{j}")), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(k) for j in range(k))).first()
        m = np.array([[crossed[f"s{i}_{j}"] for j in range(k)] for i in range(k)])
        meat += (1 - lag / (lags + 1)) * (m + m.T)
    cov = inverse @ meat @ inverse
    rss, tss = products[k, k] - coef @ products[:k, k], products[k, k] - products[0, k] ** 2 / n
    r2 = 1 - rss / tss if tss else float("nan")
    return Fit(["const", "trend", "level", "slope"], coef, np.sqrt(np.maximum(np.diag(cov), 0)), n, n - k, r2, 1 - (1 - r2) * (n - 1) / (n - k) if n > k else float("nan"), cov=cov)


def component_weights(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Each column's weight, which add up to 1: its squared loading on the first component of the correlations.

    Correlations are over the rows that have both of two columns, from one pass; where they don't fit together, negative
    eigenvalues are taken as 0. A constant column, or one without values, has no weight; without any other, all weigh the same.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    c = [F.col(x).cast("double") for x in columns]
    row = df.agg(*(correlation(c[i], c[j]).alias(f"r{i}_{j}") for i, j in pairs), *(F.var_pop(x).alias(f"v{i}") for i, x in enumerate(c))).first()
    live = [i for i in range(len(columns)) if (row[f"v{i}"] or 0.0) > 0]
    if not live:
        return dict.fromkeys(columns, 1 / len(columns))
    r = np.eye(len(live))
    for a, i in enumerate(live):
        for b, j in enumerate(live):
            if i < j:
                v = row[f"r{i}_{j}"]
                r[a, b] = r[b, a] = 0.0 if v is None or np.isnan(v) else v
    values, vectors = np.linalg.eigh(r)
    repaired = (vectors * np.maximum(values, 0)) @ vectors.T
    first = np.linalg.eigh(repaired / np.sqrt(np.outer(np.diag(repaired), np.diag(repaired))))[1][:, -1]
    return {x: float(first[live.index(i)] ** 2) if i in live else 0.0 for i, x in enumerate(columns)}


def weighted_composite(df: DataFrame, weights: dict[str, float], score: str = "score") -> DataFrame:
    """df with score: the weighted mean of columns over those that a row has; null without any that weighs."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        top, bottom = top + F.coalesce(F.col(c) * w, F.lit(0.0)), bottom + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    return df.withColumn(score, top / F.nullif(bottom, F.lit(0.0)))
