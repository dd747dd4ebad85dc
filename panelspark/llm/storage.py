"""Where intermediate tables go, the folder that the session names in spark.checkpoint.dir, and how much tasks hold of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and Python, so that rows of long texts are few in one.
BATCH_BYTES = 4 << 20

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, local mode takes one under the temp folder; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/panelspark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless they are bounded more tightly already.

    Buffers outside the heap are as large as the largest batch, and stay with an executor for its life.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later jobs start from files that any executor can read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables cut has written that are still there: where a job that clears up after itself begins."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that cut wrote, from number `since` on, but the last `keep`: for the end of a job, or of a step whose
    result is written."""
    gone = _written[since : max(since, len(_written) - keep)]
    del _written[since : since + len(gone)]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """DataFrame.checkpoint in the shared folder, for small tables of iterative jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def unused(columns: Sequence[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be no column, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
