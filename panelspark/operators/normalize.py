"""Scaling within groups, quantile bins and two-way demeaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clip_keep_null
from ..functions.lineage import checkpoint

#: Rows of a group up to which one task picks its percentiles.
GROUP_ROWS = 5_000_000
#: Rows of a group up to which its bracket is the whole group, and the share of ranks that brackets leave on each side of a point.
BRACKET_ROWS = 20_000
BRACKET_SHARE = 2e-4
#: Periods that panels may have.
MOST_PERIODS = 1_000


def _over(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))


def with_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[Column]) -> DataFrame:
    """df with aggregates of its groups, joined back from one partly pre-aggregated pass; keys match null-safely.

    The aggregate has a row for each group; Spark sends it to all tasks where it is small enough, else joins by shuffle.
    """
    return with_stats_of(df, df.groupBy(*keys).agg(*stats), keys)


def minmax_within(df: DataFrame, columns: Sequence[str], keys: Sequence[str], inverted: Sequence[str] = ()) -> DataFrame:
    """Columns scaled to 0 to 1 within each group; a constant group gives 0.5, a null stays null; inverted ones are 1 - x."""
    stats = [f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    out = with_stats(df, keys, stats)
    for c in columns:
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled = F.when(F.col(c).isNull(), None).when(high == low, F.lit(0.5)).otherwise((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)))
        out = out.withColumn(c, 1 - scaled if c in inverted else scaled)
    return out.drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def percentiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], keys: Sequence[str] = (), group_rows: int = GROUP_ROWS, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """keys and, for each column, _q_{column}: its exact (interpolated) percentiles at the points, in their order.

    Where a group is larger than group_rows, no task holds its values: a sketch brackets each point, and ranks are counted
    exactly within the brackets only. The result is the same. What brackets need of such groups, of which there are few, is
    sent to all tasks, so that no row of theirs is moved; the other groups are left to Spark's percentile.
    """
    def plain(some: DataFrame) -> DataFrame:
        return some.groupBy(*keys).agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, points))).alias(f"_q_{c}") for c in columns))

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= group_rows:
        return plain(df)
    if not keys:
        return _bracketed(df, columns, points, keys, bracket_rows)
    large = with_stats_of(df, F.broadcast(sizes.filter(F.col("_rows") > group_rows)), keys)
    others = plain(large.filter("_rows IS NULL"))
    return _bracketed(large.filter("_rows IS NOT NULL"), columns, points, keys, bracket_rows).select(*others.columns).union(others)


def _bracketed(df: DataFrame, columns: Sequence[str], points: Sequence[float], keys: Sequence[str], bracket_rows: int) -> DataFrame:
    """percentiles of few large groups."""
    by = [*(f"_k{i}" for i in range(len(keys))), "variable"]
    long = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x"))
    long = long.select(*by[:-1], "x.variable", "x.value").filter("value IS NOT NULL")
    lower, upper = ([min(max(p + s * BRACKET_SHARE, 0.0), 1.0) for p in points] for s in (-1, 1))
    base = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", [*lower, *upper], 10_000).alias("sketch"))

    def edge(i: int, side: int) -> Column:
        if points[i] in (0.0, 1.0):  # the bracket is this value alone
            return F.col("least" if points[i] == 0.0 else "most")
        return F.when(F.col("n") <= bracket_rows, F.col(("least", "most")[side])).otherwise(F.col("sketch")[i + side * len(points)])

    base = base.select(*by, *(edge(i, s).alias(f"_e{i}_{s}") for i in range(len(points)) for s in (0, 1)))
    joined = with_stats_of(long, F.broadcast(base), by)  # a row for each large group and column
    # One pass counts rows: by value within brackets, else by how many brackets begin at or below. In this order the sums are ranks.
    inside = reduce(or_, (F.col("value").between(F.col(f"_e{i}_0"), F.col(f"_e{i}_1")) for i in range(len(points))))
    begun = reduce(add, ((F.col("value") >= F.col(f"_e{i}_0")).cast("int") for i in range(len(points))))
    counted = joined.groupBy(*by, begun.alias("begun"), F.when(inside, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("times"))
    own = W.partitionBy(*by)
    ranked = counted.withColumns({"upto": F.sum("times").over(own.orderBy("begun", F.asc_nulls_last("value"))), "last": F.sum("times").over(own) - 1})

    def at(p: float) -> Column:
        rank = F.lit(p) * F.col("last")
        low, high = (F.min(F.when(F.col("upto") > f(rank), F.col("value"))) for f in (F.floor, F.ceil))
        rank = F.lit(p) * F.first("last")
        return low + (rank - F.floor(rank)) * (high - low)

    arrays = ranked.groupBy(*by).agg(F.array(*map(at, points)).alias("q"))
    wide = arrays.groupBy(*by[:-1]).agg(*(F.first(F.when(F.col("variable") == c, F.col("q")), ignorenulls=True).alias(f"_q_{c}") for c in columns))
    return wide.withColumnsRenamed({f"_k{j}": k for j, k in enumerate(keys)})


def with_stats_of(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of groups, a row for each combination of keys, which match null-safely."""
    if not keys:
        return df.crossJoin(F.broadcast(groups))  # one row
    groups = groups.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition &= df[k].eqNullSafe(groups[f"_k_{k}"])
    return df.join(groups, condition, "left").drop(*(f"_k_{k}" for k in keys))


def winsor_minmax(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns clipped to their group's exact percentiles and scaled to 0 to 1; unchanged where these don't differ."""
    out = with_stats_of(df, percentiles(df, columns, [low, high], keys), keys)
    for c in columns:
        a, b = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        clipped = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), a), b))
        out = out.withColumn(c, F.when(b > a, (clipped - a) / F.nullif(b - a, F.lit(0.0))).otherwise(F.col(c)))
    return out.drop(*(f"_q_{c}" for c in columns))


def share_within(df: DataFrame, column: str, keys: Sequence[str], out: str = "share") -> DataFrame:
    """x over its group's sum; 0 where that isn't positive."""
    total = F.sum(column).over(_over(keys))
    return df.withColumn(out, F.when(total > 0, F.col(column) / F.nullif(total, F.lit(0))).otherwise(F.lit(0.0)))


def zscore(df: DataFrame, column: str, keys: Sequence[str] = (), out: str = "z") -> DataFrame:
    """Centred, and divided by the sample deviation where that is positive."""
    stats = [F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd")]
    joined = with_stats(df, keys, stats)
    return joined.withColumn(out, F.when(F.col("_sd") > 0, (F.col(column) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).otherwise(F.col(column) - F.col("_mean"))).drop("_mean", "_sd")


def quantile_bins(df: DataFrame, column: str, bins: int, keys: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """The number (from 0) of x's quantile bin: exact edges, repeated ones dropped, right-closed, the lowest value included.

    df is read again for its edges: a value that may differ when it is made again, as a sum of doubles, is to be checkpointed before.
    """
    edges = percentiles(df, [column], [k / bins for k in range(bins + 1)], keys).withColumn("_edges", F.array_distinct(f"_q_{column}")).drop(f"_q_{column}")
    joined = with_stats_of(df, edges, keys)
    # Edges under x; the first bin takes its lower edge too.
    below = reduce(add, (F.coalesce((F.get("_edges", F.lit(i)) < F.col(column)).cast("int"), F.lit(0)) for i in range(bins + 1)))
    return joined.withColumn(out, F.when(F.col(column).isNotNull() & (F.size("_edges") > 1), F.greatest(below - 1, F.lit(0)))).drop("_edges")


def centred(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with out: the column less its mean over all rows."""
    mean = df.agg(F.avg(column).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(out, F.col(column) - F.col("_mean")).drop("_mean")  # one row


def demean_within(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Columns less their means by key, which are aggregated partially and joined back."""
    joined = with_stats(df, [key], [F.avg(c).alias(f"_m_{c}") for c in columns])
    return joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns))


def demean_two_way(df: DataFrame, columns: Sequence[str], entity: str, period: str, most: int = MOST_PERIODS) -> DataFrame:
    """Columns less their entity's and period's effects, exactly, balanced panel or not.

    Period effects solve normal equations as large as the number of periods (an error beyond `most`): of columns and
    period indicators, each less its entity's mean. Rows with a null key or column take no part in them.
    """
    rows = df.na.drop(subset=[*columns, entity, period])
    sums = demean_within(rows, columns, entity).groupBy(period).agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)), F.count(F.lit(1)).alias("_n")).limit(most + 1).collect()
    if len(sums) > most:
        raise ValueError(f"more than {most} periods")
    # How often an entity's rows lie in each two periods, over its number of rows: a list is no longer than there are periods.
    cells = rows.groupBy(entity, period).agg(F.count(F.lit(1)).alias("n")).groupBy(entity).agg(F.collect_list(F.struct(F.col(period).alias("p"), "n")).alias("cells"), F.sum("n").alias("total"))
    pairs = cells.select(F.explode("cells").alias("a"), "cells", "total").select("a", F.explode("cells").alias("b"), "total")
    shared = pairs.groupBy(F.col("a.p").alias("p"), F.col("b.p").alias("q")).agg(F.sum(F.col("a.n") * F.col("b.n") / F.col("total")).alias("m")).collect()
    place = {r[period]: i for i, r in enumerate(sums)}
    left, right = np.diag([float(r["_n"]) for r in sums]), np.array([[r[f"_s{i}"] for i in range(len(columns))] for r in sums]).reshape(-1, len(columns))
    for r in shared:
        left[place[r["p"]], place[r["q"]]] -= r["m"]
    effects = np.linalg.lstsq(left, right, rcond=None)[0] if sums else right
    schema = f"_period {df.schema[period].dataType.simpleString()}, " + ", ".join(f"_e{i} double" for i in range(len(columns)))
    of = df.sparkSession.createDataFrame([(p, *map(float, effects[k])) for p, k in place.items()], schema)
    shifted = df.join(F.broadcast(of), df[period] == of["_period"], "left")  # a row for each period, of which there are few
    shifted = shifted.withColumns({c: F.col(c) - F.coalesce(f"_e{i}", F.lit(0.0)) for i, c in enumerate(columns)}).drop("_period", *(f"_e{i}" for i in range(len(columns))))
    return demean_within(shifted, columns, entity)


def bivariate_classes(df: DataFrame, x: str, y: str, out: str = "bivariate") -> DataFrame:
    """3 * y's tercile + x's tercile: how many of its column's two exact tercile points a value exceeds, be they equal or not.

    df is checkpointed: sums of doubles differ in their last digits when they are made again, and a value that is a point itself
    must be compared with itself.
    """
    rows = checkpoint(df)
    columns = sorted({x, y})
    joined = with_stats_of(rows, percentiles(rows, columns, [1 / 3, 2 / 3]), [])
    tercile = {c: reduce(add, ((F.col(c) > F.col(f"_q_{c}")[i]).cast("int") for i in (0, 1))) for c in columns}
    return joined.withColumn(out, 3 * tercile[y] + tercile[x]).drop(*(f"_q_{c}" for c in columns))


def coverage(beneficiaries: Column, population: Column) -> tuple[Column, Column]:
    """Share covered, within 0 and 1, and the rest; both null without population."""
    covered = clip_keep_null(beneficiaries.cast("double") / F.nullif(population.cast("double"), F.lit(0.0)), 0, 1)
    return covered, F.lit(1.0) - covered
