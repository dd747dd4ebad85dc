"""Regression on panels, robust errors, spatial autocorrelation and intervals, as aggregates and small linear algebra.

Only cross-products, as large as the number of regressors, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import chi2_cdf, t_quantile, two_sided_t
from .normalize import demean_two_way, demean_within


@dataclass
class Fit:
    """Coefficients with standard errors, t, p and 95 % bounds, by name."""

    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    df: int
    r2: float
    r2_adjusted: float
    r2_within: float = float("nan")
    r2_between: float = float("nan")
    r2_overall: float = float("nan")
    cov: np.ndarray | None = None

    def rows(self) -> list[tuple]:
        half = t_quantile(0.975, self.df) if self.df > 0 else float("nan")
        out = []
        for name, b, s in zip(self.names, self.coef.tolist(), self.se.tolist(), strict=True):
            t = b / s if s else float("nan")
            out.append((name, b, s, t, two_sided_t(t, self.df) if s and self.df > 0 else float("nan"), b - half * s, b + half * s, self.n, float(self.r2), float(self.r2_adjusted), float(self.r2_within), float(self.r2_between), float(self.r2_overall)))
        return out


def result_frame(spark, fits: dict[str, Fit]) -> DataFrame:
    """A row for each model and term."""
    rows = [(model, *r) for model, fit in fits.items() for r in fit.rows()]
    return spark.createDataFrame(rows, "model string, term string, coef double, se double, t double, p double, ci_low double, ci_high double, n long, r2 double, r2_adjusted double, r2_within double, r2_between double, r2_overall double")


def cross_products(df: DataFrame, columns: Sequence[Column], by_row: Column | None = None) -> np.ndarray:
    """The matrix of sums of products of each two columns, times by_row, in one pass."""
    k = len(columns)
    weight = F.lit(1.0) if by_row is None else by_row
    sums = [F.coalesce(F.sum(columns[i] * columns[j] * weight), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.agg(*sums).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"]
    return out


def _dot(columns: Sequence[Column], values: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, v in zip(columns, values.tolist(), strict=True):
        out = out + c * F.lit(float(v))
    return out


def evaluate(fit: Fit, terms: dict[str, Column]) -> Column:
    """The fitted value where the terms (by name, the constant aside) have these values."""
    return F.lit(float(fit.coef[fit.names.index("const")])) + _dot([terms[n] for n in fit.names if n != "const"], np.array([b for n, b in zip(fit.names, fit.coef, strict=True) if n != "const"]))


def ols_hc3(df: DataFrame, y: str, x: Sequence[str], terms: dict[str, Column] | None = None) -> Fit:
    """Least squares with an intercept and HC3 errors: one pass for the normal equations, one for leverage and residuals.

    terms adds named expressions, such as powers. Rows with a null are left out.
    """
    names = ["const", *x, *(terms or {})]
    rows = df.select(F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in x), *(e.cast("double").alias(n) for n, e in (terms or {}).items())).na.drop()
    regressors = [F.lit(1.0), *(F.col(f"`{n}`") for n in names[1:])]
    k = len(regressors)
    all_products = cross_products(rows, [*regressors, F.col("_y")])
    n = int(all_products[0, 0])
    inverse = np.linalg.inv(all_products[:k, :k])
    coef = inverse @ all_products[:k, k]
    residual = F.col("_y") - _dot(regressors, coef)
    leverage = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            leverage = leverage + regressors[i] * regressors[j] * F.lit(float(inverse[i, j]))
    scaled = rows.withColumn("_e", residual).withColumn("_h", leverage)
    e3 = F.col("_e") / F.nullif(F.lit(1.0) - F.col("_h"), F.lit(0.0))
    meat = cross_products(scaled, regressors, e3 * e3)
    cov = inverse @ meat @ inverse
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    rss = all_products[k, k] - coef @ all_products[:k, k]
    tss = all_products[k, k] - all_products[0, k] ** 2 / n
    r2 = 1 - rss / tss if tss else float("nan")
    return Fit(names, coef, se, n, n - k, r2, 1 - (1 - r2) * (n - 1) / (n - k) if n > k else float("nan"), cov=cov)


def polynomial(df: DataFrame, y: str, x: str, degree: int) -> Fit:
    """y on x, x squared, ... with HC3 errors."""
    return ols_hc3(df, y, [x], {f"{x}^{d}": F.pow(F.col(x), F.lit(float(d))) for d in range(2, degree + 1)})


def fixed_effects(df: DataFrame, y: str, x: Sequence[str], entity: str, period: str, two_way: bool = True, least: int = 10, small_sample: bool = True) -> Fit | None:
    """Within regression with errors clustered by entity; None under `least` complete rows.

    With small_sample the covariance is scaled by G / (G - 1) * (n - 1) / (n - k). r2 is that of the regression itself;
    r2_within (of deviations from entity means), r2_between (of entity means) and r2_overall (of the rows) are those of its
    coefficients, about zero, as there is no constant.
    """
    columns, k = [*x, y], len(x)
    rows = df.select(entity, period, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop().cache()
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(period).alias("t")).first()
    n = counts["n"]
    if n < least:
        rows.unpersist()
        return None
    # Each row's values, their deviations from entity means, and those from both effects; then sums of products by entity.
    wide = demean_within(rows.withColumns({f"_{v}{i}": F.col(c) for v in "rb" for i, c in enumerate(columns)}), [f"_b{i}" for i in range(k + 1)], entity)
    wide = demean_two_way(wide, columns, entity, period) if two_way else wide.withColumns({c: F.col(f"_b{i}") for i, c in enumerate(columns)})
    versions = {"w": columns, "b": [f"_b{i}" for i in range(k + 1)], "r": [f"_r{i}" for i in range(k + 1)]}
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = [F.sum(F.col(of[i]) * F.col(of[j])).alias(f"{v}{i}_{j}") for v, of in versions.items() for i, j in pairs]
    by_entity = wide.groupBy(entity).agg(*sums, *(F.avg(f"_r{i}").alias(f"m{i}") for i in range(k + 1))).cache()
    means = [F.sum(F.col(f"m{i}") * F.col(f"m{j}")).alias(f"m{i}_{j}") for i, j in pairs]
    total = by_entity.agg(F.count(F.lit(1)).alias("g"), *means, *(F.sum(f"{v}{i}_{j}").alias(f"{v}{i}_{j}") for v in versions for i, j in pairs)).first()

    def products(v: str) -> np.ndarray:
        return np.array([[total[f"{v}{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])

    g, within = total["g"], products("w")
    inverse = np.linalg.inv(within[:k, :k])
    coef = inverse @ within[:k, k]
    scores = [F.col(f"w{i}_{k}") - _dot([F.col(f"w{min(i, j)}_{max(i, j)}") for j in range(k)], coef) for i in range(k)]
    meat = cross_products(by_entity, scores)
    factor = g / (g - 1) * (n - 1) / (n - k) if small_sample and g > 1 and n > k else 1.0
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * factor, 0))
    full = np.append(-coef, 1.0)

    def share(m: np.ndarray) -> float:
        return 1 - float(full @ m @ full) / m[k, k] if m[k, k] else float("nan")

    by_entity.unpersist()
    rows.unpersist()
    df_left = n - k - g - (counts["t"] - 1 if two_way else 0)
    return Fit(list(x), coef, se, n, max(df_left, 1), share(within), float("nan"), *(share(products(v)) for v in "bmr"))


def hausman(df: DataFrame, y: str, x: Sequence[str], entity: str) -> dict[str, float]:
    """The Hausman statistic of entity effects against random effects without a constant, with its p-value."""
    columns = [y, *x]
    rows = df.select(entity, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    over = W.partitionBy(entity)
    wide = rows.withColumns({f"m_{c}": F.avg(c).over(over) for c in columns} | {"_t": F.count(F.lit(1)).over(over)}).cache()
    k = len(x)
    inner = [F.col(c) - F.col(f"m_{c}") for c in (*x, y)]
    products = cross_products(wide, inner)
    size = wide.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(entity).alias("g")).first()
    n, g = size["n"], size["g"]
    inverse = np.linalg.inv(products[:k, :k])
    fe = inverse @ products[:k, k]
    s2_e = (products[k, k] - fe @ products[:k, k]) / (n - g - k)
    # Between regression without a constant for the variance of entity effects.
    means = wide.groupBy(entity).agg(*(F.first(f"m_{c}").alias(f"m_{c}") for c in columns), F.first("_t").alias("_t"))
    between = cross_products(means, [F.col(f"m_{c}") for c in (*x, y)])
    b = np.linalg.solve(between[:k, :k], between[:k, k])
    s2_b = (between[k, k] - b @ between[:k, k]) / max(g - k, 1)
    harmonic = g / means.agg(F.sum(F.lit(1.0) / F.col("_t"))).first()[0]
    s2_u = max(0.0, s2_b - s2_e / harmonic)
    theta = F.lit(1.0) - F.sqrt(F.lit(float(s2_e)) / (F.lit(float(s2_e)) + F.col("_t") * F.lit(float(s2_u))))
    quasi = cross_products(wide, [F.col(c) - theta * F.col(f"m_{c}") for c in (*x, y)])
    re_inverse = np.linalg.inv(quasi[:k, :k])
    re = re_inverse @ quasi[:k, k]
    s2_re = (quasi[k, k] - re @ quasi[:k, k]) / max(n - k, 1)
    wide.unpersist()
    apart = fe - re
    statistic = max(0.0, float(apart @ np.linalg.pinv(s2_e * inverse - s2_re * re_inverse) @ apart))
    return {"statistic": statistic, "df": k, "p": float(1 - chi2_cdf(statistic, k))}


def morans_i(values: DataFrame, edges: DataFrame, node: str = "id", value: str = "value") -> DataFrame:
    """n, weights and Moran's I of a value over directed edges (src, dst, w), rows standardised; nodes without a value are left out."""
    seen = values.select(F.col(node).alias("_id"), F.col(value).cast("double").alias("_v")).na.drop()
    mean = seen.agg(F.avg("_v").alias("_mean"))
    centred = seen.crossJoin(F.broadcast(mean)).select("_id", (F.col("_v") - F.col("_mean")).alias("_z"))  # one row
    a, b = centred.toDF("src", "z_src"), centred.toDF("dst", "z_dst")
    pairs = edges.join(a, "src").join(b, "dst")
    total = pairs.groupBy("src").agg(F.sum("w").alias("_w"))
    weighted = pairs.join(total, "src").select((F.col("w") / F.nullif(F.col("_w"), F.lit(0.0))).alias("w"), "z_src", "z_dst")
    top = weighted.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("z_src") * F.col("z_dst")).alias("cross"))
    bottom = centred.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("square"))
    return top.crossJoin(bottom).select("n", "s0", (F.col("n") / F.nullif(F.col("s0"), F.lit(0.0)) * F.col("cross") / F.nullif(F.col("square"), F.lit(0.0))).alias("morans_i"))  # two rows of one


def _hashed_rank(df: DataFrame, keys: Sequence[str], hashed: Column, node: str) -> DataFrame:
    """df with _k, each row's place (from 1) in its group in the order of a hex digest: places within the digest's first two
    digits, plus the rows before these."""
    rows = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, 2))
    sizes = rows.groupBy(*keys, "_b").count()
    before = sizes.select(*keys, "_b", (F.sum("count").over(W.partitionBy(*keys).orderBy("_b")) - F.col("count")).alias("_before"))
    within = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", node))
    return rows.withColumn("_w", within).join(before, [*keys, "_b"]).withColumn("_k", F.col("_before") + F.col("_w")).drop("_h", "_b", "_w", "_before")


def morans_test(values: DataFrame, edges: DataFrame, node: str = "id", value: str = "value", permutations: int = 99, seed: int = 7, least: int = 4) -> DataFrame:
    """morans_i, expected, z and p of a permutation test, in one plan.

    Permutation k gives the nodes' values, in the order of a digest of the node, to the nodes in the order of a digest of node, seed and
    k. p is (more extreme permutations + 1) / (permutations + 1); all but morans_i are null without edges. Fewer than `least` nodes with
    a value give no row.
    """
    seen = values.select(F.col(node).alias("_id"), F.col(value).cast("double").alias("_v")).na.drop()
    moments = seen.agg(F.avg("_v").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    seen = seen.crossJoin(F.broadcast(moments)).select("_id", (F.col("_v") - F.col("_mean")).alias("_z"), "_n")  # one row
    name = F.col("_id").cast("string")
    one = F.lit(0).alias("_one")
    places = _hashed_rank(seen.select("_id", "_z", one), ["_one"], F.md5(F.concat(name, F.lit(":values"))), "_id").select("_z", "_k")
    drawn = seen.select("_id", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("_p"))
    drawn = _hashed_rank(drawn, ["_p"], F.md5(F.concat(name, F.lit(f":{seed}:"), F.col("_p").cast("string"))), "_id").join(places, "_k").select("_p", "_id", "_z")
    every = drawn.union(seen.select(F.lit(0).alias("_p"), "_id", "_z"))
    kept = edges.join(seen.select(F.col("_id").alias("src")), "src").join(seen.select(F.col("_id").alias("dst")), "dst")
    total = kept.groupBy("src").agg(F.sum("w").alias("_w"))
    weighted = kept.join(total, "src").select("src", "dst", (F.col("w") / F.nullif(F.col("_w"), F.lit(0.0))).alias("w"))
    crossed = weighted.join(every.toDF("_p", "src", "_a"), "src").join(every.toDF("_p", "dst", "_b"), ["_p", "dst"])
    of = crossed.groupBy("_p").agg(F.sum("w").alias("_s0"), F.sum(F.col("w") * F.col("_a") * F.col("_b")).alias("_cross"))
    square = seen.agg(F.sum(F.col("_z") * F.col("_z")).alias("_square"), F.max("_n").alias("_n"))
    i = F.col("_n") / F.nullif(F.col("_s0"), F.lit(0.0)) * F.col("_cross") / F.nullif(F.col("_square"), F.lit(0.0))
    found = of.crossJoin(F.broadcast(square)).filter(F.col("_n") >= least).select("_p", i.alias("_i"))  # a row for each permutation
    observed = found.filter("_p = 0").select(F.col("_i").alias("morans_i"))
    sims = found.filter("_p > 0").crossJoin(F.broadcast(observed))
    out = sims.groupBy("morans_i").agg(F.avg("_i").alias("expected"), F.stddev_pop("_i").alias("_sd"), F.count_if(F.col("_i") >= F.col("morans_i")).alias("_larger"))
    p = (F.least("_larger", F.lit(permutations) - F.col("_larger")) + 1) / F.lit(permutations + 1.0)
    return out.select("morans_i", "expected", ((F.col("morans_i") - F.col("expected")) / F.nullif(F.col("_sd"), F.lit(0.0))).alias("z"), p.alias("p"))


def with_interpretation(test: DataFrame, level: float = 0.05) -> DataFrame:
    """morans_test with what it says: positive or negative autocorrelation where p is under the level, none else, null without p."""
    sign = F.when(F.col("morans_i") > 0, "positive").otherwise("negative")
    said = F.when(F.col("p") < level, F.concat(sign, F.lit(" spatial autocorrelation"))).when(F.col("p").isNotNull(), "no significant autocorrelation")
    return test.withColumn("interpretation", said)


def r_squared(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """rmse, mae and r2 of predictions."""
    e = F.col(y) - F.col(predicted)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.lit(1.0) - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"))
