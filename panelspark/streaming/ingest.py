"""Streaming ingest of landed files, an extension: the batch sources land as files, and each event counts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_landing(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(events: DataFrame, keys: Sequence[str], ts: str, delay: str = "2 days") -> DataFrame:
    """Repeated events within the watermark are dropped; state is bounded by the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, ts: str, by: Sequence[str], width: str = "1 hour", value: str = "value") -> DataFrame:
    """window_start, keys, n and total of each closed window."""
    grouped = events.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def to_parquet(df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """Writes what there is and ends; the checkpoint makes a restart go on where it stopped."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(*by) if by else writer).start()
