"""Queries of trees, causal forests, attributions and imputation, with the settings of published analyses.

SQL can express none of the fits; tests compare them with plain loops, all subsets of features, and known effects.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint, shared_folder
from ..operators import curves, imputation
from ..operators import models as M
from ..operators import normalize as N
from ..operators import stats as S
from ..operators import trees as T
from .catalogue import _DIMS, _PANEL, events, full, panel, query, r, scores, table

FEATURES = ["d1", "d2", "d3", "d4"]
TREES, ROUNDS = 500, 200
DRAWS, SWEEPS = 5, 10


def _modelled(spark: SparkSession, d: str) -> DataFrame:
    """The scored panel with its region; a missing dimension counts as 0.5."""
    region = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity"), "n_regionkey")
    return scores(spark, d).join(region, "entity").na.fill(0.5, FEATURES)


@query()
def forest_cross_validation(spark, d):
    return M.cross_validate(_modelled(spark, d), FEATURES, "cost", "n_regionkey", "rf", trees=TREES)


@query()
def forest_importances(spark, d):
    return M.importances(_modelled(spark, d), FEATURES, "cost", "rf", trees=TREES)


@query()
def boosting_fold_summary(spark, d):
    rows = checkpoint(_modelled(spark, d).select("entity", "period", "n_regionkey", "cost", *FEATURES))  # the tables are read once
    return M.fold_summary(M.boosted_fold_metrics(rows, FEATURES, "cost", "n_regionkey", ["entity", "period"], ROUNDS))


@query()
def forest_attributions(spark, d):
    """What each dimension adds to each entity's and period's cost as a forest predicts it, beside a base that is the same for all."""
    rows = checkpoint(_modelled(spark, d).select("entity", "period", "cost", *FEATURES))
    if rows.isEmpty():
        return rows.select("entity", "period", *(F.lit(None).cast("double").alias(f"shap_{c}") for c in FEATURES), F.lit(None).cast("double").alias("base"))
    model = M.refit(rows, FEATURES, "cost", "rf", TREES)
    paths = T.paths_of(T.mllib_nodes(model, f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"), FEATURES, [1 / TREES] * TREES)
    return T.attributions(rows, paths, ["entity", "period"])


@query()
def attribution_importance(spark, d):
    """The mean size of each dimension's attributions."""
    return T.mean_attributions(forest_attributions(spark, d), FEATURES)


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, T.CausalForest | None]:
    """The panel, and a forest of the effect of the score on the cost of a procedure, by income, population and deaths."""
    rows = full(spark, d).join(scores(spark, d).select("entity", "period", "score"), ["entity", "period"])
    region = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity"), F.col("n_regionkey").cast("long").alias("region"))
    rows = rows.join(region, "entity").withColumns({"price": F.col("cost") / F.col("procedures"), "people": F.col("population").cast("double"), "died": F.col("deaths").cast("double")})
    rows = checkpoint(rows.select("entity", "period", "region", "score", "price", "income", "people", "died"))
    modifiers = ["income", "people", "died"]
    residuals = M.dml_residuals(rows, "price", "score", modifiers, ["entity", "period"], keep=modifiers)
    return rows, residuals and T.causal_forest(residuals, modifiers, ["entity", "period"], trees=TREES)


@query()
def causal_forest_effects(spark, d):
    rows, forest = _forest(spark, d)
    if forest is None:
        return spark.createDataFrame([], "entity long, period long, effect double, se double, ci_low double, ci_high double")
    return T.effects(rows, forest, ["entity", "period"])


def _effects_by(spark: SparkSession, d: str, group: str) -> DataFrame:
    rows, forest = _forest(spark, d)
    if forest is None:
        return spark.createDataFrame([], "group string, n long, effect double, se double, ci_low double, ci_high double")
    rows = N.quantile_bins(rows, "people", 3, out="tercile").withColumn("all", F.lit("all"))
    return T.effects_by(rows, forest, group)


@query()
def causal_forest_by_region(spark, d):
    return _effects_by(spark, d, "region")


@query()
def causal_forest_by_tercile(spark, d):
    return _effects_by(spark, d, "tercile")


@query()
def causal_forest_mean(spark, d):
    return _effects_by(spark, d, "all")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("entity", "period", "d1", "d2", "d3", F.col("procedures").cast("double").alias("procedures"))


@query()
def chained_imputation(spark, d):
    return imputation.impute(_gaps(spark, d), ["d2"], ["d1", "d3", "procedures"], ["entity", "period"], DRAWS, SWEEPS)


@query()
def imputed_means(spark, d):
    """The mean of an imputed dimension, with the variance within and between draws; of all cells where none is missing."""
    drawn = imputation.posterior_draws(_gaps(spark, d), ["d2"], ["d1", "d3", "procedures"], ["entity", "period"], DRAWS, SWEEPS)
    return imputation.pooled_means(_gaps(spark, d).select(F.lit(0).alias("draw"), "d2") if drawn is None else drawn, ["d2"])


@query(_DIMS + f"SELECT 'd2' AS variable, period, count(*) FILTER (WHERE d2 IS NULL) AS n_imputed, count(*) AS n_total, 'chained' AS method, {DRAWS} AS draws, {SWEEPS} AS sweeps FROM cs GROUP BY period")
def imputation_log(spark, d):
    return M.imputation_log(scores(spark, d), ["d2"], "period", "chained", DRAWS, SWEEPS)


@query()
def spline_dose_response(spark, d):
    """Order prices on a restricted cubic spline of the day of the year, with a joint test of curvature."""
    rows = events(spark, d).select(F.dayofyear("o_orderdate").cast("double").alias("day"), F.col("o_totalprice").alias("price"))
    found = curves.restricted_spline(rows, "price", "day")
    if found is None:
        return spark.createDataFrame([], "term string, coef double, se double, curvature double, p_curvature double")
    fit, _, test = found
    out = S.result_frame(spark, {"spline": fit}).select("term", "coef", "se")
    return out.withColumns({"curvature": F.lit(test["statistic"]), "p_curvature": F.lit(test["p"])})


@query(
    _PANEL
    + """, x AS (SELECT entity, period, cost / 1000 AS y, CAST(period - 1998 AS DOUBLE) AS t, CASE WHEN period >= 1998 THEN 1.0 ELSE 0.0 END AS p FROM panel),
g AS (SELECT *, t * p AS s, count(*) OVER (PARTITION BY p) AS n, avg(t) OVER (PARTITION BY p) AS mt, avg(y) OVER (PARTITION BY p) AS my FROM x),
b AS (SELECT p, sum((t - mt) * (y - my)) / sum((t - mt) * (t - mt)) AS slope, any_value(my) AS my, any_value(mt) AS mt FROM g GROUP BY p)
SELECT round(a.slope, 4) AS trend, round(c.my - c.slope * c.mt - (a.my - a.slope * a.mt), 4) AS level, round(c.slope - a.slope, 4) AS slope FROM b a, b c WHERE a.p = 0 AND c.p = 1"""
)
def interrupted_series_changes(spark, d):
    """The change of level and slope of yearly cost from 1998 on; standard errors have a test of their own."""
    fit = curves.interrupted_series(panel(spark, d).withColumn("y", F.col("cost") / 1000), "y", "entity", "period", 1998)
    rows = spark.createDataFrame([tuple(float(x) for x in fit.coef[1:])], "trend double, level double, slope double")
    return rows.select(*(r(c, 4).alias(c) for c in ("trend", "level", "slope")))


@query()
def component_composite(spark, d):
    """The scored panel's dimensions in one score by the weights of their first component."""
    rows = scores(spark, d).select("entity", "period", *FEATURES)
    return curves.weighted_composite(rows, curves.component_weights(rows, FEATURES)).select("entity", "period", r("score").alias("score"))
