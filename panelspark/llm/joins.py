"""Equality joins whose frequent keys are dealt out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint

#: Rows of a key that stay in one task at least, and keys that are dealt to several tasks at most.
HOT_ROWS = 1_000
HOT_KEYS = 50_000


def key_counts(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys of rows without nulls, with n, how many rows have each; counted where the rows are first."""
    return checkpoint(rows.dropna(subset=list(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("n")))


def join_evenly(rows: DataFrame, table: DataFrame, on: Sequence[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_anti) with table, of which a key has a few rows at most; rows may share a key as they like.

    Keys of more than a bounded share of the rows are known from their counts (the keys with n, if the caller has them): fewer
    than HOT_KEYS by construction, so that they can be sent to all tasks. Their rows are dealt out by a hash of the whole row, and
    their rows of the table are copied to each part. Rows that are equal in all columns stay together; so do rows with a null
    in a key. Columns of the two other than `on` have different names.
    rows are read several times, and so should be written or checkpointed before.
    """
    on = list(on)
    if counts is None:
        if rows.count() <= HOT_ROWS:
            return rows.join(table, on, how)
        counts = key_counts(rows, on)
    total, largest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    if largest <= most:
        return rows.join(table, on, how)
    hot = F.broadcast(counts.filter(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).alias("_parts")))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1)))
    left = rows.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    right = table.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")
