"""Grouped cross-validation, tree ensembles and double machine learning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import trees as T
from .aggregate import with_t_interval
from .stats import r_squared


def group_folds(df: DataFrame, group: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """df with a fold (from 0) for each group; no group is in two. Groups are dealt in their order, as evenly as can be."""
    names = df.select(group).na.drop().distinct()
    n = min(folds, names.count())
    place = (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(group)) - 1) % F.lit(max(n, 1))
    return df.join(names.withColumn(out, place.cast("int")), group)


def hash_folds(df: DataFrame, keys: Sequence[str], folds: int = 5, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int"))


def _vectors(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    rows = df.na.drop(subset=[*features, label])
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)


def tree_model(kind: str, label: str, trees: int, depth: int = 6, seed: int = 7):
    """A random forest ("rf") or gradient boosting ("gbt")."""
    common = {"featuresCol": "_features", "labelCol": label, "predictionCol": "predicted", "maxDepth": depth, "seed": seed}
    return RandomForestRegressor(numTrees=trees, **common) if kind == "rf" else GBTRegressor(maxIter=trees, stepSize=0.1, subsamplingRate=0.8, **common)


def cross_validate(df: DataFrame, features: Sequence[str], label: str, group: str, kind: str = "rf", trees: int = 20, folds: int = 5) -> DataFrame:
    """fold, rmse, mae and r2 on each fold's groups by a model of the others."""
    rows = group_folds(_vectors(df, features, label), group, folds).cache()
    out = []
    for k in range(min(folds, rows.select("fold").distinct().count())):
        predicted = tree_model(kind, label, trees).fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k))
        out.append((k, *r_squared(predicted, label, "predicted").select("rmse", "mae", "r2").first()))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "fold int, rmse double, mae double, r2 double")


def boosted_fold_metrics(df: DataFrame, features: Sequence[str], label: str, group: str, keys: Sequence[str], rounds: int = 200, folds: int = 5, **options) -> DataFrame:
    """fold, rmse, mae and r2 of second-order boosting on each fold's groups; the folds' models grow side by side."""
    rows = group_folds(df.na.drop(subset=[*features, label]), group, folds)
    model = T.boost(rows, features, label, keys, "fold", rounds, **options)
    if model is None:
        return df.sparkSession.createDataFrame([], "fold int, rmse double, mae double, r2 double")
    e = F.col(label) - F.col("predicted")
    square = F.avg(e * e)
    by_fold = T.boosted_predictions(rows, model, ["fold", label], "fold").groupBy("fold")
    return by_fold.agg(F.sqrt(square).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.lit(1.0) - square / F.nullif(F.var_pop(label), F.lit(0.0))).alias("r2"))


def importances(df: DataFrame, features: Sequence[str], label: str, kind: str = "rf", trees: int = 20) -> DataFrame:
    """feature and importance by impurity; trees.attributions has the effect of each feature on each row."""
    model = tree_model(kind, label, trees).fit(_vectors(df, features, label))
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def lasso(gram: np.ndarray, penalty: float, sweeps: int = 1_000) -> np.ndarray:
    """Coefficients, the constant first, by coordinate descent on the sums of products of (1, controls, label).

    Controls are scaled by their deviations; the penalty is that of half the mean square of the residuals.
    """
    n, k = gram[0, 0], len(gram) - 2
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    live = scale > 1e-12
    unit = np.where(live, scale, 1.0)
    xx, xy = cov[:k, :k] / np.outer(unit, unit), cov[:k, k] / unit
    b = np.zeros(k)
    for _ in range(sweeps):
        old = b.copy()
        for j in np.flatnonzero(live):
            rest = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - penalty, 0.0) / xx[j, j]
        if np.abs(b - old).max(initial=0.0) < 1e-12:
            break
    b = b / unit
    return np.append(mean[k] - b @ mean[:k], b)


def choose_penalty(grams: Sequence[np.ndarray], penalties: int = 30, least: float = 1e-3) -> float:
    """The penalty with the least mean square over the parts, each predicted by a model of the others, of a grid down from the
    smallest penalty that leaves no control."""
    total = np.sum(grams, axis=0)
    k, n = len(total) - 2, total[0, 0]
    mean = total[0, 1:] / n
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    most = float(np.max(np.abs(cov[:k, k]) / np.where(scale > 1e-12, scale, np.inf), initial=0.0))
    grid = [most * least ** (i / (penalties - 1)) for i in range(penalties)] if most > 0 else [0.0]
    errors = []
    for penalty in grid:
        error = 0.0
        for part in grams:
            full = np.append(-lasso(total - part, penalty), 1.0)
            error += float(full @ part @ full)
        errors.append(error)
    return grid[int(np.argmin(errors))]


def dml_residuals(df: DataFrame, outcome: str, treatment: str, controls: Sequence[str], keys: Sequence[str], folds: int = 5, penalty: float | None = None, least: int = 50, keep: Sequence[str] = ()) -> DataFrame | None:
    """keys, columns to keep, and cross-fitted lasso residuals _d of the treatment and _y of the outcome; None under `least` rows.

    Rows with a null are left out. Each fold's residuals come from a model of the others, whose penalty, unless given, is chosen
    by cross-validation over these. One pass adds up products of columns by fold; all models are solved from them.
    """
    columns = [*controls, treatment, outcome]
    rows = hash_folds(df.select(*dict.fromkeys((*keys, *keep)), *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns))).na.drop(subset=[f"_c{i}" for i in range(len(columns))]), keys, folds, "_fold")
    terms = [F.lit(1.0), *(F.col(f"_c{i}") for i in range(len(columns)))]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    grams = {}
    for r in rows.groupBy("_fold").agg(*(F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in pairs)).collect():
        m = np.zeros((len(terms), len(terms)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        grams[r["_fold"]] = m
    if sum(m[0, 0] for m in grams.values()) < least or len(grams) < 3:
        return None
    k = len(controls)
    fitted = {"_d": F.lit(None).cast("double"), "_y": F.lit(None).cast("double")}
    for fold in grams:
        for name, label in (("_d", k + 1), ("_y", k + 2)):
            own = [*range(k + 1), label]
            others = [m[np.ix_(own, own)] for f, m in grams.items() if f != fold]
            coef = lasso(np.sum(others, axis=0), choose_penalty(others) if penalty is None else penalty)
            guess = F.lit(float(coef[0]))
            for i in range(k):
                guess = guess + F.col(f"_c{i}") * F.lit(float(coef[1 + i]))
            fitted[name] = F.when(F.col("_fold") == fold, F.col(f"_c{label - 1}") - guess).otherwise(fitted[name])
    return rows.select(*dict.fromkeys((*keys, *keep)), *(c.alias(n) for n, c in fitted.items()))


def double_ml(df: DataFrame, outcome: str, treatment: str, controls: Sequence[str], keys: Sequence[str], folds: int = 5, penalty: float | None = None, least: int = 50) -> dict[str, float] | None:
    """The effect of a treatment on an outcome by cross-fitted lasso residuals, with a robust error; None under `least` rows."""
    residuals = dml_residuals(df, outcome, treatment, controls, keys, folds, penalty, least)
    if residuals is None:
        return None
    s = residuals.agg(F.sum(F.col("_d") * F.col("_y")).alias("dy"), F.sum(F.col("_d") * F.col("_d")).alias("dd"), F.count(F.lit(1)).alias("n")).first()
    effect = s["dy"] / s["dd"]
    e = F.col("_y") - F.lit(effect) * F.col("_d")
    meat = residuals.agg(F.sum(F.col("_d") * F.col("_d") * e * e)).first()[0]
    return {"effect": effect, "se": meat**0.5 / s["dd"], "n": s["n"]}


def fold_summary(metrics: DataFrame, columns: Sequence[str] = ("rmse", "mae", "r2")) -> DataFrame:
    """metric, n, mean, sd and the t interval of its mean over the folds."""
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns))).alias("m")).select("m.*")
    stats = long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return with_t_interval(stats)


def refit(df: DataFrame, features: Sequence[str], label: str, kind: str = "rf", trees: int = 20):
    """A model of all complete rows, for use after cross-validation; its transform wants the column _features."""
    return tree_model(kind, label, trees).fit(_vectors(df, features, label))


def effects_by_group(df: DataFrame, outcome: str, treatment: str, group: str) -> DataFrame:
    """group, n and slope of the outcome on the treatment; trees.effects_by has a causal forest's effects by group."""
    return df.na.drop(subset=[outcome, treatment]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.covar_samp(treatment, outcome) / F.nullif(F.var_samp(treatment), F.lit(0.0))).alias("slope"))


def imputation_log(before: DataFrame, targets: Sequence[str], period: str, method: str, draws: int, sweeps: int) -> DataFrame:
    """variable, period, cells imputed, and how."""
    long = before.select(period, *(F.col(c).cast("double").alias(c) for c in targets)).unpivot(period, list(targets), "variable", "value")
    out = long.groupBy("variable", period).agg(F.count_if(F.col("value").isNull()).alias("n_imputed"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumns({"method": F.lit(method), "draws": F.lit(draws), "sweeps": F.lit(sweeps)})
