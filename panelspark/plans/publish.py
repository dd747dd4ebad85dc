"""Publication: namespaced Parquet trees, manifests and their verification, idempotent partition writes and upserts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import upsert

#: Characters of a table name at most: what catalogues and file systems commonly take.
NAME_LENGTH = 128


def plain_name(name: str) -> bool:
    """ASCII letters, digits and underscores, no digit first, of a bounded length."""
    return name.isascii() and name.isidentifier() and len(name) <= NAME_LENGTH


def namespace(table: str, rules: Sequence[tuple[str, str]], default: str = "other") -> str:
    """The namespace of the first rule whose substring is in the table's name."""
    return next((space for part, space in rules if part in table), default)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], overwrite_touched: bool = True) -> None:
    """Writes Hive-style partitions; those that df has rows of are replaced, all others stay. A partition's rows come from one place, not from every task."""
    spread = df.repartition(*by) if by else df
    spread.write.mode("overwrite" if overwrite_touched else "append").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_partitions(spark: SparkSession, wanted: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """The wanted keys that the tree doesn't have yet: what an interrupted run has still to do."""
    return wanted.join(spark.read.parquet(path).select(*by).distinct(), list(by), "left_anti")


def compact(df: DataFrame, path: str, by: Sequence[str], files: int = 1) -> None:
    """Rewrites partitions with so many files each at most; the rows of a partition are spread by a hash of their content."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(*by, part).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_ordered(df: DataFrame, path: str, by: Sequence[str], file_rows: int = 1_000_000) -> None:
    """Writes df in the order of `by` (nulls first) over files of about file_rows rows: files in the order of their names, each sorted.

    No value of `by` is in two files, so that statistics of files don't overlap and a reader of one value opens one.
    """
    files = max(1, -(-df.count() // file_rows))
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def file_ranges(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """file, n, and low_ and high_ of each column of `by`, of each file under the path."""
    ends = [f(c).alias(f"{n}_{c}") for c in by for f, n in ((F.min, "low"), (F.max, "high"))]
    return spark.read.parquet(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"), *ends)


def export_tree(tables: Mapping[str, DataFrame], root: str, rules: Sequence[tuple[str, str]]) -> list[str]:
    """Writes each table to root/namespace/name as zstd Parquet; a name that isn't a plain identifier is refused."""
    out = []
    for name, df in tables.items():
        if not plain_name(name):
            raise ValueError(f"unsafe table name {name!r}")
        path = f"{root}/{namespace(name, rules)}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out.append(path)
    return out


def export_catalog(spark: SparkSession, root: str, rules: Sequence[tuple[str, str]]) -> list[str]:
    """The same for the catalogue's tables, without views."""
    names = [t.name for t in spark.catalog.listTables() if t.tableType != "VIEW" and not t.isTemporary]
    return export_tree({n: spark.table(n) for n in names}, root, rules)


def _measured(spark: SparkSession, root: str) -> DataFrame:
    """path (under root), bytes, sha256 and rows of every Parquet file of a tree on any file system; tasks read the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    # Schemes are written with one slash or three; the path after them is the same.
    below = F.expr(f"substr(regexp_replace(path, '^[a-z0-9]+:/+', '/'), length(regexp_replace('{full}', '^[a-z0-9]+:/+', '/')) + 2)")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows = [], []
            for content in batch["content"]:
                data = content.as_buffer()
                digests.append(hashlib.sha256(data).hexdigest())
                rows.append(pq.ParquetFile(pa.BufferReader(data)).metadata.num_rows)
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(digests), pa.array(rows, pa.int64())], names=["path", "bytes", "sha256", "rows"])

    return files.select("path", "length", "content").mapInArrow(measure, "path string, bytes long, sha256 string, rows long").select(below.alias("path"), "bytes", "sha256", "rows")


def build_manifest(spark: SparkSession, root: str) -> dict:
    """Files of a tree with size, digest, rows and their table's schema, and totals. The manifest itself is as long as the list of files."""
    files = []
    schemas: dict[str, dict] = {}
    for r in _measured(spark, str(root)).orderBy("path").toLocalIterator():
        folder = str(PurePosixPath(r["path"]).parent)
        if folder not in schemas:
            schemas[folder] = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{root}/{r['path']}").schema}
        files.append({"path": r["path"], "bytes": r["bytes"], "sha256": r["sha256"], "rows": r["rows"], "schema": schemas[folder]})
    return {"files": files, "total_files": len(files), "total_bytes": sum(f["bytes"] for f in files), "total_rows": sum(f["rows"] for f in files)}


def write_manifest(spark: SparkSession, root: str) -> dict:
    manifest = build_manifest(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(manifest, indent=2, sort_keys=True), "utf-8"))
    out.close()
    return manifest


def verify_manifest(spark: SparkSession, root: str, manifest: Mapping) -> list[str]:
    """What is wrong: paths that leave the tree, missing files, other digests or rows, and files that aren't listed."""
    found = {r["path"]: r for r in _measured(spark, str(root)).toLocalIterator()}
    wrong, listed = [], set()
    for entry in manifest["files"]:
        path = PurePosixPath(entry["path"])
        if path.is_absolute() or ".." in path.parts:
            wrong.append(f"unsafe path {path}")
            continue
        listed.add(str(path))
        own = found.get(str(path))
        if own is None:
            wrong.append(f"missing {path}")
        elif own["sha256"] != entry["sha256"]:
            wrong.append(f"digest of {path}")
        elif own["rows"] != entry["rows"]:
            wrong.append(f"rows of {path}")
    return wrong + [f"unlisted {p}" for p in sorted(found) if p not in listed]


def register_views(spark: SparkSession, root: str, manifest: Mapping, allowed: Iterable[str]) -> list[str]:
    """A temporary view for each allowed table directory of the manifest."""
    names = sorted({PurePosixPath(f["path"]).parent.name for f in manifest["files"]} & set(allowed))
    for n in names:
        paths = sorted({str(PurePosixPath(root) / PurePosixPath(f["path"]).parent) for f in manifest["files"] if PurePosixPath(f["path"]).parent.name == n})
        spark.read.parquet(*paths).createOrReplaceTempView(n)
    return names


def upsert_tree(spark: SparkSession, new: DataFrame, path: str, target: str, keys: Sequence[str], replace: bool = True) -> None:
    """The table at path with new's rows put in, written to another place: a reader never sees half of it."""
    upsert(spark.read.parquet(path), new, keys, replace).write.mode("overwrite").parquet(target)
