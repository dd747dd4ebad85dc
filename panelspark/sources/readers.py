"""Readers: wide and irregular CSV, Parquet trees, JSON tables and envelopes, ZIP members, and pinned empty tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import number


#: What decoders put for bytes that are no character.
BROKEN = "[\ufffd\u0080-\u009f]"


def first_that_loads(spark: SparkSession, loaders: Sequence[tuple[str, Callable[[SparkSession], DataFrame]]]) -> DataFrame:
    """The first source that can be read, in order, with its name in the column _source; an error if none can. Nothing is made up."""
    failed = []
    for name, load in loaders:
        try:
            df = load(spark)
            df.limit(1).count()
        except (AnalysisException, SparkRuntimeException, FileNotFoundError, Py4JJavaError) as error:
            failed.append(f"{name}: {str(error).splitlines()[0]}")
            continue
        return df.withColumn("_source", F.lit(name))
    raise ValueError("; ".join(failed) or "no source")


def with_estimated_flag(df: DataFrame, period: str, first: int, out: str = "estimated") -> DataFrame:
    """Whether a period's value is an estimate: those from `first` on."""
    return df.withColumn(out, F.coalesce(F.col(period) >= first, F.lit(False)))


def facility_list(spark: SparkSession, path: str, item: str, key: str, keep: Column, envelopes: Sequence[str] = ("data", "results", "items", "value")) -> DataFrame:
    """One row for each key (the smallest of the others' values) of the objects in pages of JSON that are to be kept."""
    rows = envelope_json(spark, path, item, envelopes).filter(F.coalesce(keep, F.lit(False)))
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_first")).select(key, *(F.col(f"_first.{c}").alias(c) for c in others))


def entity_master(localities: DataFrame, coordinates: DataFrame, key: str) -> DataFrame:
    """Localities with their coordinates, where there are any: one row of each, whatever the coordinates' number."""
    others = [c for c in coordinates.columns if c != key]
    one = coordinates.groupBy(key).agg(F.min(F.struct(*others)).alias("_first")).select(key, *(F.col(f"_first.{c}").alias(c) for c in others))
    return localities.join(one, key, "left")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """A source that failed still has its schema."""
    return spark.createDataFrame([], schema)


def wide_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], numbers: Sequence[str] = (), sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Those of the wanted columns that the file has, whatever their case; numbers that aren't are null. Other columns aren't parsed."""
    df = spark.read.options(header=True, sep=sep, encoding=encoding, mode="PERMISSIVE").csv(path)
    by_lower = {c.lower(): c for c in df.columns}
    kept = [(c, by_lower[c.lower()]) for c in columns if c.lower() in by_lower]
    return df.select(*((number(F.col(f"`{own}`")) if c in numbers else F.col(f"`{own}`")).alias(c) for c, own in kept))


def dotted_number(x: Column) -> Column:
    """A number with dots between thousands and a decimal comma."""
    return number(F.regexp_replace(F.regexp_replace(F.trim(x), r"\.", ""), ",", "."))


def _encoded_csv(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """A CSV file as text. Spark doesn't read windows-1252: it is ISO-8859-1 with other characters for most of U+0080 to U+009F."""
    wide = encoding.lower() in ("windows-1252", "cp1252")
    df = spark.read.options(header=True, sep=sep, encoding="ISO-8859-1" if wide else encoding, mode="PERMISSIVE").csv(path)
    if not wide:
        return df
    pairs = [(chr(b), c) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))]
    old, new = ("".join(x) for x in zip(*pairs, strict=True))
    return df.select(*(F.translate(F.col(f"`{c}`"), old, new).alias(c.translate(str.maketrans(old, new))) for c in df.columns))


def sniff_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1", "windows-1252"), separators: Sequence[str] = (";", ",", "\t"), least: int = 3) -> DataFrame:
    """Reads with the first encoding and separator that give `least` columns and no broken character, in header or rows.

    Rows are all looked at, as a broken character may stand in any; that ends at the first one. Control characters from U+0080
    to U+009F count as broken: ISO-8859-1 has them where other encodings have quotation marks and dashes.
    """
    for encoding in encodings:
        for sep in separators:
            df = _encoded_csv(spark, path, sep, encoding)
            if len(df.columns) < least:
                continue
            if any(re.search(BROKEN, c) for c in df.columns):
                break
            broken = F.exists(F.array(*(F.col(f"`{c}`") for c in df.columns)), lambda x: x.rlike(BROKEN))
            if df.filter(broken).limit(1).count():
                break  # another separator doesn't mend it
            return df
    raise ValueError(f"{path}: no encoding and separator give {least} columns")


def parquet_tree(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, years: tuple[int, int] | None = None, year: str = "year") -> DataFrame:
    """Parquet files with differing columns; a range of years prunes partitions, or row groups where year is a plain column."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.schema(schema).parquet(*paths) if schema else spark.read.option("mergeSchema", True).parquet(*paths)
    return df.filter(F.col(year).between(*years)) if years else df


def with_file_period(df: DataFrame, pattern: str = r"_(\d{4})(\d{2})", names: Sequence[str] = ("year", "month")) -> DataFrame:
    """Columns that only the file's name says."""
    path = F.input_file_name()
    return df.withColumns({n: F.regexp_extract(path, pattern, i + 1).try_cast("int") for i, n in enumerate(names)})


def header_row_json(spark: SparkSession, path: str, fields: Mapping[str, str], skip: Column) -> DataFrame:
    """A JSON array of objects, all strings, one of which describes the columns: skip says which. fields: new name to key."""
    keys = list(dict.fromkeys(fields.values()))
    df = spark.read.schema(T.StructType([T.StructField(k, T.StringType()) for k in keys])).json(path, multiLine=True)
    return df.filter(~F.coalesce(skip, F.lit(False))).select(*(F.col(k).alias(n) for n, k in fields.items()))


def envelope_json(spark: SparkSession, path: str, item: str, envelopes: Sequence[str] = ("data", "results", "items", "value")) -> DataFrame:
    """Objects in an array that stands under one of several keys; item is the DDL schema of an object."""
    text = spark.read.text(path, wholetext=True)
    one_of = F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{e}"), f"array<struct<{item}>>") for e in envelopes), F.from_json("value", f"array<struct<{item}>>"))
    return text.select(F.inline(one_of))


def series_values(df: DataFrame, level: str, level_value: str, date: str, year: int) -> DataFrame:
    """The rows of one level and year of a series with timestamps in text."""
    return df.filter((F.col(level) == level_value) & (F.year(F.try_to_timestamp(F.col(date))) == year))


def zip_members(spark: SparkSession, path: str, pattern: str, encoding: str = "utf-8") -> DataFrame:
    """archive, member, text and error of the members of ZIP files whose names match; an archive is unpacked in one task.

    A member whose bytes aren't of the encoding, or that can't be unpacked, has no text but an error; so has an archive that
    can't be opened, without a member.
    """
    matcher = re.compile(pattern)

    def unpack(batches):
        import pandas as pd

        def row(archive, member, text, error):
            return pd.DataFrame({"archive": [archive], "member": [member], "text": [text], "error": [error]})

        for frame in batches:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as e:
                    yield row(archive, None, None, str(e))
                    continue
                with z:
                    for name in sorted(n for n in z.namelist() if matcher.search(n)):
                        try:
                            yield row(archive, name, z.read(name).decode(encoding), None)
                        except (UnicodeDecodeError, zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                            yield row(archive, name, None, str(e))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, text string, error string")


def table_census(spark: SparkSession, required: Sequence[str] = ()) -> DataFrame:
    """table and n, its rows, of every table and view of the session's catalogue; an error that names the required ones that aren't there."""
    found = sorted(t.name for t in spark.catalog.listTables())
    if missing := sorted(set(required) - set(found)):
        raise ValueError(f"tables missing: {', '.join(missing)}")
    counts = [spark.table(t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n")) for t in found]
    return reduce(DataFrame.union, counts) if counts else spark.createDataFrame([], "table string, n long")


def table_filter(spark: SparkSession, table: str, condition: str | None = None) -> DataFrame:
    df = spark.table(table)
    return df.filter(condition) if condition else df
