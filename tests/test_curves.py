"""Splines, interrupted series and component weights against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import curves


def test_spline_equals_numpy_and_is_straight_beyond_its_knots(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 400)
    y = np.sin(x) + 0.2 * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, None)], "x double, y double")
    fit, knots, test = curves.restricted_spline(df, "y", "x")
    assert np.allclose(knots, np.quantile(x, [0.05, 0.35, 0.65, 0.95]))
    plus = lambda v, t: np.maximum(v - t, 0) ** 3
    k = knots

    def basis(v):
        terms = [(plus(v, k[j]) - plus(v, k[2]) * (k[3] - k[j]) / (k[3] - k[2]) + plus(v, k[3]) * (k[2] - k[j]) / (k[3] - k[2])) / (k[3] - k[0]) ** 2 for j in range(2)]
        return np.column_stack([np.ones(len(v)), v, *terms])

    design = basis(x)
    inverse = np.linalg.inv(design.T @ design)
    coef = inverse @ design.T @ y
    e = (y - design @ coef) / (1 - np.einsum("ij,jk,ik->i", design, inverse, design))
    cov = inverse @ (design.T * e**2) @ design @ inverse
    assert np.allclose(fit.coef, coef) and np.allclose(fit.cov, cov)
    assert test["statistic"] == pytest.approx(coef[2:] @ np.linalg.solve(cov[2:, 2:], coef[2:])) and test["df"] == 2 and test["p"] < 1e-6
    far = basis(np.array([20.0, 21.0, 22.0, -5.0, -6.0, -7.0])) @ fit.coef
    assert far[2] - far[1] == pytest.approx(far[1] - far[0]) and far[5] - far[4] == pytest.approx(far[4] - far[3])
    straight = curves.restricted_spline(df.withColumn("y", 2 * F.col("x") + F.pmod(F.xxhash64("x"), F.lit(100)) / 100.0), "y", "x")[2]
    assert straight["p"] > 1e-3
    assert curves.restricted_spline(df.withColumn("x", F.lit(1.0)), "y", "x") is None and curves.restricted_spline(df.limit(0), "y", "x") is None


@pytest.mark.parametrize("lags", [0, 2])
def test_interrupted_series_equals_dense_matrices(spark, lags):
    rng = np.random.default_rng(2)
    rows = []
    for e in range(12):
        noise = 0.0
        for t in range(2000, 2016):
            noise = 0.6 * noise + rng.normal()
            if (e, t) != (3, 2005):  # a gap
                rows.append((f"e{e}", t, 5 + 0.3 * (t - 2008) + (2 + 0.7 * (t - 2008)) * (t >= 2008) + noise))
    df = spark.createDataFrame([*rows, ("x", 2001, None)], "e string, t int, y double")
    fit = curves.interrupted_series(df, "y", "e", "t", 2008, lags)
    t = np.array([r[1] - 2008.0 for r in rows])
    design = np.column_stack([np.ones(len(t)), t, t >= 0, t * (t >= 0)])
    y = np.array([r[2] for r in rows])
    inverse = np.linalg.inv(design.T @ design)
    coef = inverse @ design.T @ y
    u = design * (y - design @ coef)[:, None]
    meat = np.zeros((4, 4))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            apart = abs(a[1] - b[1])
            if a[0] == b[0] and apart <= lags:
                meat += (1 - apart / (lags + 1)) * np.outer(u[i], u[j])
    assert np.allclose(fit.coef, coef) and np.allclose(fit.cov, inverse @ meat @ inverse) and fit.n == len(rows)
    assert abs(fit.coef[2] - 2) < 1.5 and abs(fit.coef[3] - 0.7) < 0.3


def test_component_weights_equal_numpy(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=300)
    x = np.column_stack([common + 0.3 * rng.normal(size=300), -common + rng.normal(size=300), rng.normal(size=300)])
    names = ["a", "b", "c", "flat", "none"]
    df = spark.createDataFrame([(*map(float, r), 1.0, None) for r in x], "a double, b double, c double, flat double, none double")
    got = curves.component_weights(df, names)
    want = np.linalg.eigh(np.corrcoef(x.T))[1][:, -1] ** 2
    assert [got[c] for c in names] == pytest.approx([*want, 0, 0]) and sum(got.values()) == pytest.approx(1)
    assert curves.component_weights(df, names[::-1]) == pytest.approx(got)
    holes = df.withColumn("a", F.when(F.col("c") > 0, F.col("a"))).withColumn("b", F.when(F.col("c") < 0.1, F.col("b")))
    assert sum(curves.component_weights(holes, names).values()) == pytest.approx(1)
    assert curves.component_weights(df.limit(0), ["a", "b"]) == {"a": 0.5, "b": 0.5}
    rows = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a double, b double")
    assert [r["score"] for r in curves.weighted_composite(rows, {"a": 0.25, "b": 0.75}).collect()] == [1.0, None, 2.5]
