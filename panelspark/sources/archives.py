"""ZIP archives by their directories: one task a member, whatever the archive's size, and members read as streams.

A task reads an archive's directory, at its end, and then only the bytes of its own members. Files are opened by their URI
through Arrow's file systems (local, HDFS, object stores); `opener` takes a path and gives a seekable binary file where Arrow
doesn't know the scheme. `readers.zip_members` is for file systems that only Spark reaches; it takes an archive whole.

Defined cases: a path without files is Spark's error; an archive that can't be opened, and a member that can't be unpacked or
isn't of the encoding, give a row with an error and nulls, after the rows that could be read; folders in an archive aren't
members; names that occur twice in an archive are two members; an empty archive or member gives no row.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that members are dealt to, at most; further members share them.
MOST_TASKS = 20_000
#: Bytes of a member's text that a task parses at once; a record must fit in it.
BLOCK_BYTES = 4 << 20

_DIRECTORY = "archive string, place int, member string, bytes long, packed long, error string"
_broken = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, UnicodeError, csv.Error, pa.ArrowInvalid)


class _Ranged(io.RawIOBase):
    """An Arrow file as a raw file, whose errors are those that zipfile knows."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("a position before the file's start")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def open_uri(path: str) -> BinaryIO:
    """A file that tells and seeks, by its URI or local path."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return io.BufferedReader(_Ranged(system.open_input_file(name)), 1 << 16)


def zip_directory(spark: SparkSession, path: str, pattern: str = "", opener: Callable[[str], BinaryIO] = open_uri) -> DataFrame:
    """archive, place (in its directory), member, bytes, packed and error of the members whose names match; no member is read."""
    matcher = re.compile(pattern)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "place", "member", "bytes", "packed", "error"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for archive in batch["path"].to_pylist():
                try:
                    with opener(archive) as f, zipfile.ZipFile(f) as z:
                        rows = [(archive, i, m.filename, m.file_size, m.compress_size, None) for i, m in enumerate(z.infolist()) if not m.is_dir() and matcher.search(m.filename)]
                except _broken as e:
                    rows = [(archive, None, None, None, None, str(e))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    # Of files only their paths are wanted: Spark doesn't read their content then.
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(listed, _DIRECTORY)


def _dealt(spark: SparkSession, path: str, pattern: str, opener: Callable[[str], BinaryIO]) -> DataFrame:
    """The directory with its members dealt out, a task for each."""
    members = zip_directory(spark, path, pattern, opener)
    return members.repartition(min(MOST_TASKS, max(1, members.count())))


def _each(run: Callable[[BinaryIO], Iterator[pa.RecordBatch]], opener, columns: Sequence[str]):
    """A task's work: run on each member's file, and what went wrong in the column error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled(row: dict, n: int, found: list, error: str | None) -> pa.RecordBatch:
            own = [pa.array([row[c]] * n, pa.string()) for c in ("archive", "member")]
            return pa.RecordBatch.from_arrays([*own, *found, pa.array([error] * n, pa.string())], names=["archive", "member", *columns, "error"])

        for batch in batches:
            for row in batch.to_pylist():
                error = row["error"]
                if error is None:
                    try:
                        with opener(row["archive"]) as f, zipfile.ZipFile(f) as z:
                            member = z.infolist()[row["place"]]
                            for part in run(lambda z=z, member=member: z.open(member)):
                                if isinstance(part, str):
                                    error = part
                                else:
                                    yield labelled(row, part.num_rows, part.columns, None)
                    except _broken as e:
                        error = str(e) or type(e).__name__
                if error is not None:
                    yield labelled(row, 1, [pa.array([None], f) for f in run.types], error)

    return read


def zip_lines(spark: SparkSession, path: str, pattern: str = "", encoding: str = "utf-8", opener: Callable[[str], BinaryIO] = open_uri) -> DataFrame:
    """archive, member, line_no (from 0), line and error of the members whose names match."""

    def run(member) -> Iterator[pa.RecordBatch]:
        first, held, size = 0, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.string())], names=["line_no", "line"])

        with io.TextIOWrapper(member(), encoding) as lines:
            try:
                for line in lines:
                    held.append(line.rstrip("\n"))
                    size += len(line)
                    if size >= BLOCK_BYTES:
                        yield batch()
                        first, held, size = first + len(held), [], 0
            except _broken as e:
                yield batch()
                yield str(e)
                return
        yield batch()

    run.types = (pa.int64(), pa.string())
    return _dealt(spark, path, pattern, opener).mapInArrow(_each(run, opener, ["line_no", "line"]), "archive string, member string, line_no long, line string, error string")


def zip_csv(spark: SparkSession, path: str, pattern: str, columns: Sequence[str], sep: str = ",", encoding: str = "utf-8", opener: Callable[[str], BinaryIO] = open_uri) -> DataFrame:
    """archive, member, the wanted columns as text, and error, of the members whose names match and whose first row names columns.

    Members may have their columns in any order and case; a column that a member lacks is null, others aren't kept. Records
    with too few or too many fields are left out and counted in the member's error.
    """

    def run(member) -> Iterator[pa.RecordBatch]:
        with io.TextIOWrapper(member(), encoding, newline="") as text:
            header = [c.removeprefix("﻿") for c in next(csv.reader(text, delimiter=sep), [])]
        if not header:
            return
        own: dict[str, int] = {}
        for i, c in enumerate(header):
            own.setdefault(c.lower(), i)
        places = [own.get(c.lower()) for c in columns]
        kept = sorted({p for p in places if p is not None})
        odd = [0]

        def leave(_row) -> str:
            odd[0] += 1
            return "skip"

        names = [str(i) for i in range(len(header))]
        # Where no wanted column is there, the first one says how many rows are.
        options = pc.ConvertOptions(include_columns=[names[i] for i in kept or [0]], column_types={n: pa.string() for n in names}, strings_can_be_null=False)
        parse = pc.ParseOptions(delimiter=sep, newlines_in_values=True, invalid_row_handler=leave)
        with member() as f:
            try:
                with pc.open_csv(f, pc.ReadOptions(use_threads=False, block_size=BLOCK_BYTES, skip_rows_after_names=1, column_names=names, encoding=encoding), parse, options) as found:
                    for b in found:
                        none = pa.nulls(b.num_rows, pa.string())
                        yield pa.RecordBatch.from_arrays([none if p is None else b.column(names[p]) for p in places], names=list(columns))
            except pa.ArrowInvalid as e:
                if "Empty CSV" not in str(e):
                    raise
        if odd[0]:
            yield f"{odd[0]} records whose fields aren't {len(header)}"

    run.types = (pa.string(),) * len(columns)
    schema = ", ".join(["archive string", "member string", *(f"`{c}` string" for c in columns), "error string"])
    return _dealt(spark, path, pattern, opener).mapInArrow(_each(run, opener, columns), schema)


def directory_summary(directory: DataFrame) -> DataFrame:
    """archive, members, bytes, packed, and the smallest and largest name of each archive of a zip_directory."""
    return directory.groupBy("archive").agg(F.count("member").alias("members"), F.sum("bytes").alias("bytes"), F.sum("packed").alias("packed"), F.min("member").alias("first"), F.max("member").alias("last"))
