"""Which areas touch: edges from the vertices of boundaries, by an inverted index from places to areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Areas at one place that one task pairs with as many others.
BLOCK_AREAS = 256


def snapped(vertices: DataFrame, area: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Distinct _area, _x and _y of vertices, in whole steps of the tolerance; rows with a null are left out."""
    step = lambda c: F.floor(F.col(c).cast("double") / tolerance + 0.5).cast("long")
    return vertices.select(F.col(area).alias("_area"), step(x).alias("_x"), step(y).alias("_y")).na.drop().distinct()


def queen(vertices: DataFrame, area: str = "area", x: str = "x", y: str = "y", tolerance: float = 1e-6, least: int = 1, block_areas: int = BLOCK_AREAS) -> DataFrame:
    """src, dst and w (1.0) of each two areas that share at least `least` vertices: 1 for touching corners, 2 for a common side.

    Areas at a place that many share are dealt to blocks, and each two blocks meet in a task of their own.
    """
    index = snapped(vertices, area, x, y, tolerance)
    place = ["_x", "_y"]
    shared = index.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*place, F.ceil(F.col("_n") / block_areas).cast("int").alias("_blocks"))
    index = index.join(shared, place).withColumn("_own", F.pmod(F.xxhash64("_area"), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = index.select(*place, F.col("_area").alias("src"), F.col("_own").alias("_a"), every.alias("_b"))
    right = index.select(*place, F.col("_area").alias("dst"), every.alias("_a"), F.col("_own").alias("_b"))
    pairs = left.join(right, [*place, "_a", "_b"]).filter(F.col("src") != F.col("dst"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("src", "dst", F.lit(1.0).alias("w"))


def islands(vertices: DataFrame, edges: DataFrame, area: str = "area") -> DataFrame:
    """Areas without a neighbour."""
    return vertices.select(area).na.drop().distinct().join(edges.select(F.col("src").alias(area)).distinct(), area, "left_anti")
