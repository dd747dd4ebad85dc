"""Chained imputation by draws from the posterior of a linear model: coefficients and noise are drawn, not only noise.

A sweep goes through the targets: each one's model is solved from sums of products over the rows that have it, one matrix for
each draw and one pass for all, and its missing cells are drawn anew. Draws are columns of the same rows. Within a sweep a task
applies the updates so far to the rows that it reads; after a sweep rows are written to the checkpoint folder, so that plans
stay short. A cell's noise is a hash of the row's keys, so that a lost task draws the same again.

Defined cases: observed cells and auxiliaries stay as they are; a null auxiliary counts as the mean; a column without any value
stays null and is no predictor; a constant one has no weight; without missing cells nothing is fitted; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.quantiles import t_quantile
from .trees import _draws


@dataclass
class Update:
    """What a target's missing cells get: for each draw an intercept and coefficients of all columns (its own is 0), and noise."""

    target: int
    coef: np.ndarray
    spread: np.ndarray
    salt: int


def evidence(gram: np.ndarray, cross: np.ndarray, square: float, n: float, rounds: int = 300) -> tuple[np.ndarray, float, float, float]:
    """Mean coefficients, precision of coefficients over that of noise, sum of squared errors, and effective parameters.

    gram, cross and square are sums of products of centred predictors and label; precisions maximise the evidence.
    """
    values, vectors = np.linalg.eigh(gram)
    values, rotated = np.maximum(values, 0.0), vectors.T @ cross
    noise, weight = n / max(square, 1e-300), 1.0
    coef, sse, used = np.zeros(len(gram)), square, 0.0
    for _ in range(rounds):
        before = coef
        inner = rotated / (values + weight / noise)
        coef = vectors @ inner
        sse = max(square - 2 * float(rotated @ inner) + float(values @ inner**2), 1e-12 * max(square, 1e-300))
        used = float(np.sum(noise * values / (noise * values + weight)))
        weight = min(max(used, 1e-12) / max(float(coef @ coef), 1e-300), 1e12 * noise * max(float(values.max(initial=1.0)), 1e-12))
        noise = max(n - used, 1e-3) / sse
        if np.abs(coef - before).max(initial=0.0) <= 1e-9 * np.abs(coef).max(initial=1e-300):
            break
    return coef, weight / noise, sse, used


def draw_model(products: np.ndarray, label: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """An intercept and coefficients (0 for the label's own place), and the noise's deviation, from their posterior.

    products are sums of products of (1, columns) over the rows that have the label.
    """
    k, n = len(products) - 1, products[0, 0]
    mean = products[0, 1:] / n
    centred = products[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred) / n, 0))
    own = [j for j in range(k) if j != label and scale[j] > 1e-9 * max(1.0, abs(mean[j]))]
    unit = scale[own]
    gram, cross = centred[np.ix_(own, own)] / np.outer(unit, unit), centred[own, label] / unit
    coef, ratio, sse, used = evidence(gram, cross, float(centred[label, label]), n)
    spread = float(np.sqrt(sse / rng.chisquare(max(n - used - 1, 1.0))))
    if own:
        root = np.linalg.cholesky(gram + (ratio + 1e-9 * n) * np.eye(len(own)))  # unlike eigenvectors, it moves little when sums are rounded otherwise
        coef = coef + spread * np.linalg.solve(root.T, rng.standard_normal(len(own)))
    out = np.zeros(k + 1)
    out[1 + np.array(own, int)] = coef / unit
    out[0] = mean[label] + spread * rng.standard_normal() / np.sqrt(n) - out[1:] @ mean
    return out, spread


def _completed(batch: pa.RecordBatch, targets: int, draws: int, updates: Sequence[Update]) -> np.ndarray:
    """Rows by draws by columns (targets, then auxiliaries), missing cells of targets as the updates leave them."""
    n = batch.num_rows
    raw = batch["_x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    out = np.repeat(raw[:, None, :], draws, axis=1)
    out[:, :, :targets] = batch["_fill"].flatten().to_numpy(zero_copy_only=False).reshape(n, draws, targets)
    hashes = batch["_h"].to_numpy()
    for u in updates:
        rows = np.flatnonzero(np.isnan(raw[:, u.target]))
        own = hashes[rows]
        for d in range(draws):
            noise = np.sqrt(-2 * np.log(1 - _draws(own, u.salt + 2 * d))) * np.cos(2 * np.pi * _draws(own, u.salt + 2 * d + 1))
            out[rows, d, u.target] = u.coef[d, 0] + out[rows, d, :] @ u.coef[d, 1:] + u.spread[d] * noise
    return out


def posterior_draws(df: DataFrame, targets: Sequence[str], auxiliaries: Sequence[str], keys: Sequence[str], draws: int = 5, sweeps: int = 10, seed: int = 7) -> DataFrame | None:
    """draw, keys and targets, completed: `draws` rows of each row of df; None where no cell can or need be filled."""
    columns = [*targets, *auxiliaries]
    stats = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)), *(F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(targets))).first()
    means = [stats[f"m{i}"] for i in range(len(columns))]
    gaps = [i for i in range(len(targets)) if stats[f"g{i}"] and means[i] is not None]
    if not gaps:
        return None
    # A column without values counts as 0 throughout, which is constant and so has no weight.
    cell = lambda c, i: F.col(c).cast("double") if i < len(targets) and means[i] is not None else F.coalesce(F.col(c).cast("double"), F.lit(float(means[i] or 0.0)))
    x = F.array(*(cell(c, i) for i, c in enumerate(columns)))
    fill = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float(means[i] or 0.0))) for _ in range(draws) for i, c in enumerate(targets)))
    rows = checkpoint(df.select(*keys, F.xxhash64(*keys).alias("_h"), x.alias("_x"), fill.alias("_fill")))
    t, k = len(targets), len(columns) + 1

    def products(target: int, updates: list[Update]) -> np.ndarray:
        """For each draw the sums of products of (1, columns) over the rows that have the target."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((draws, k, k))
            for batch in batches:
                own = ~np.isnan(batch["_x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)[:, target])
                full = np.concatenate([np.ones((batch.num_rows, draws, 1)), _completed(batch, t, draws, updates)], axis=2)[own]
                held += np.einsum("ndi,ndj->dij", full, full)
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.flat[at])], names=["at", "v"])

        out = np.zeros((draws, k, k))
        for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # a row for each draw and pair of columns
            out.flat[r["at"]] = r["v"]
        return out

    for sweep in range(sweeps):
        updates: list[Update] = []
        for target in gaps:
            salt = ((seed * 4_096 + sweep) * 1_024 + target) * 4_096
            fitted = [draw_model(m, target, np.random.default_rng([seed, sweep, target, d])) for d, m in enumerate(products(target, updates))]
            updates.append(Update(target, np.array([c for c, _ in fitted]), np.array([s for _, s in fitted]), salt))

        def swept(batches: Iterator[pa.RecordBatch], updates=updates) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                filled = _completed(batch, t, draws, updates)[:, :, :t].reshape(batch.num_rows, -1)
                yield batch.set_column(batch.schema.get_field_index("_fill"), "_fill", pa.array(list(filled), pa.list_(pa.float64())))

        rows = checkpoint(rows.mapInArrow(swept, rows.schema))
    value = lambda i: F.when(F.lit(means[i] is not None), F.col("_fill")[F.col("draw") * t + i])
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("draw", *keys, *(value(i).alias(c) for i, c in enumerate(targets)))


def impute(df: DataFrame, targets: Sequence[str], auxiliaries: Sequence[str], keys: Sequence[str], draws: int = 5, sweeps: int = 10, seed: int = 7, flag: str = "is_imputed") -> DataFrame:
    """df with the missing cells of targets as the means of their draws, and flag: 1 where any target was missing. keys are unique."""
    missing = F.greatest(F.lit(0), *(F.col(c).isNull().cast("int") for c in targets))
    drawn = posterior_draws(df, targets, auxiliaries, keys, draws, sweeps, seed)
    if drawn is None:
        return df.withColumn(flag, missing)
    mean = drawn.groupBy(*keys).agg(*(F.avg(c).alias(f"_p_{c}") for c in targets))
    out = df.withColumn(flag, missing).join(mean, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_p_{c}")) for c in targets}).drop(*(f"_p_{c}" for c in targets))


def pooled_means(drawn: DataFrame, targets: Sequence[str]) -> DataFrame:
    """variable, n, draws, mean, within and between variance of the mean, and its error, by the rules for multiple imputation, with a
    t interval whose degrees of freedom follow from the two."""
    long = drawn.unpivot("draw", list(targets), "variable", "value").filter("value IS NOT NULL")
    by_draw = long.groupBy("variable", "draw").agg(F.count("value").alias("n"), F.avg("value").alias("q"), (F.var_samp("value") / F.count("value")).alias("u"))
    m = F.count(F.lit(1))
    pooled = by_draw.groupBy("variable").agg(F.max("n").alias("n"), m.alias("draws"), F.avg("q").alias("mean"), F.avg("u").alias("within"), F.coalesce(F.var_samp("q"), F.lit(0.0)).alias("between"))
    rows = []
    for r in pooled.collect():  # a row a target
        extra = (1 + 1 / r["draws"]) * r["between"]
        total = r["within"] + extra
        df = (r["draws"] - 1) * (1 + r["within"] / extra) ** 2 if extra > 0 else float("inf")
        half = t_quantile(0.975, min(df, 1e6)) * total**0.5
        rows.append((r["variable"], r["n"], r["draws"], r["mean"], r["within"], r["between"], total**0.5, r["mean"] - half, r["mean"] + half))
    return drawn.sparkSession.createDataFrame(rows, "variable string, n long, draws long, mean double, within double, between double, se double, ci_low double, ci_high double")
