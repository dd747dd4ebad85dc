"""Imputation by posterior draws: evidence against a grid, draws against their covariance, coverage of hidden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import imputation


def hidden(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    a = 2 * z + 0.5 * rng.normal(size=n) + 3
    b = a - z + 0.4 * rng.normal(size=n)
    gone_a, gone_b = rng.random(n) < 0.25, rng.random(n) < 0.25
    rows = [(i, None if gone_a[i] else float(a[i]), None if gone_b[i] else float(b[i]), float(z[i]), None, f"r{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, z double, empty double, name string"), a, b, gone_a, gone_b


def test_evidence_is_at_its_maximum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=80)
    x, y = x - x.mean(0), y - y.mean()
    coef, ratio, sse, used = imputation.evidence(x.T @ x, x.T @ y, float(y @ y), 80.0)
    assert np.allclose(coef, np.linalg.solve(x.T @ x + ratio * np.eye(3), x.T @ y)) and sse == pytest.approx(((y - x @ coef) ** 2).sum())
    noise = (80 - used) / sse

    def log_evidence(noise, weight):
        cov = np.eye(80) / noise + x @ x.T / weight
        return -0.5 * (np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y))

    best = log_evidence(noise, ratio * noise)
    assert all(log_evidence(noise * p, ratio * noise * q) <= best + 1e-6 for p in (0.8, 1, 1.25) for q in (0.7, 1, 1.4))


def test_drawn_models_spread_as_their_posterior():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [1.0, 10.0] + [5.0, -3.0]
    y = 1 + x @ [2.0, 0.1] + 0.5 * rng.normal(size=200)
    full = np.column_stack([np.ones(200), y, x])
    drawn = [imputation.draw_model(full.T @ full, 0, np.random.default_rng(k)) for k in range(3_000)]
    coef = np.array([c for c, _ in drawn])
    design = np.column_stack([np.ones(200), x])
    least = np.linalg.solve(design.T @ design, design.T @ y)
    cov = ((y - design @ least) ** 2).sum() / 197 * np.linalg.inv(design.T @ design)
    assert (coef[:, 1] == 0).all() and np.allclose(coef[:, [0, 2, 3]].mean(0), least, atol=0.02)
    assert np.allclose(coef[:, [0, 2, 3]].std(0), np.sqrt(np.diag(cov)), rtol=0.1) and np.mean([s for _, s in drawn]) == pytest.approx(0.5, rel=0.1)


def test_draws_cover_the_hidden_values(spark):
    df, a, b, gone_a, gone_b = hidden(spark)
    drawn = imputation.posterior_draws(df, ["a", "b"], ["z"], ["id"], draws=15, sweeps=4).toPandas()
    assert len(drawn) == 15 * 400
    for name, truth, gone in (("a", a, gone_a), ("b", b, gone_b)):
        by = drawn.groupby("id")[name]
        mean, sd = by.mean().to_numpy(), by.std().to_numpy()
        assert np.allclose(mean[~gone], truth[~gone]) and np.allclose(sd[~gone], 0)
        inside = np.abs(truth[gone] - mean[gone]) < 2.14 * (1 + 1 / 15) ** 0.5 * sd[gone]
        assert 0.88 < inside.mean() < 0.995 and np.corrcoef(mean[gone], truth[gone])[0, 1] > 0.8
    pooled = {r["variable"]: r for r in imputation.pooled_means(spark.createDataFrame(drawn), ["a", "b"]).collect()}
    for name, truth in (("a", a), ("b", b)):
        q = drawn.groupby("draw")[name]
        r = pooled[name]
        assert r["between"] == pytest.approx(q.mean().var()) and r["within"] == pytest.approx((q.var() / 400).mean())
        assert r["se"] ** 2 == pytest.approx(r["within"] + (1 + 1 / 15) * r["between"]) and r["ci_low"] < truth.mean() < r["ci_high"]


def test_observed_cells_stay_and_draws_repeat(spark):
    df, a, *_ = hidden(spark, 120)
    one = imputation.impute(df, ["a", "b", "empty"], ["z"], ["id"], draws=3, sweeps=2)
    assert one.columns == [*df.columns, "is_imputed"]
    got = one.toPandas().sort_values("id", ignore_index=True)
    was = df.toPandas().sort_values("id", ignore_index=True)
    assert got["a"].notna().all() and got["empty"].isna().all() and (got["name"] == was["name"]).all()
    assert np.allclose(got["a"][was["a"].notna()], was["a"].dropna()) and got["is_imputed"].tolist() == was[["a", "b", "empty"]].isna().any(axis=1).astype(int).tolist()
    again = imputation.impute(df.repartition(5), ["a", "b", "empty"], ["z"], ["id"], draws=3, sweeps=2).toPandas().sort_values("id", ignore_index=True)
    assert np.allclose(got["a"], again["a"]) and np.allclose(got["b"], again["b"])
    other = imputation.impute(df, ["a", "b", "empty"], ["z"], ["id"], draws=3, sweeps=2, seed=8).toPandas().sort_values("id", ignore_index=True)
    assert not np.allclose(got["a"], other["a"])


def test_nothing_to_fill(spark):
    df, *_ = hidden(spark, 30)
    full = df.na.fill(0.0, ["a", "b"])
    assert imputation.posterior_draws(full, ["a", "b"], ["z"], ["id"]) is None
    got = imputation.impute(full, ["a", "b"], ["z"], ["id"])
    assert {r["is_imputed"] for r in got.collect()} == {0} and sorted(got.drop("is_imputed").collect()) == sorted(full.collect())
    assert imputation.impute(df.limit(0), ["a"], ["z"], ["id"]).count() == 0
    constant = df.withColumns({"z": F.lit(None).cast("double"), "b": F.lit(1.0)})
    assert imputation.impute(constant, ["a"], ["z", "b"], ["id"], draws=2, sweeps=2).filter("a IS NULL").count() == 0
