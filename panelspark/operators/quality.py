"""The validation gate and other data-quality checks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """A check that must hold does not."""


@dataclass
class Report:
    """What a validation found: rows read and kept, failures of each check, and samples of bad entities."""

    source: str
    n_rows: int
    n_clean: int
    failures: dict[str, int]
    samples: dict[str, list[str]] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return not any(self.failures.values())

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"passed": self.passed}, indent=2, sort_keys=True)


def checked(df: DataFrame, valid: DataFrame, entity: str, period: str, first: int, last: int, order: Sequence[str] = ()) -> DataFrame:
    """df with _reason: invalid_entity, bad_period, duplicate_key or null; the first that applies.

    valid has the valid entities in a column named like `entity`. Of equal keys among otherwise good rows, the first in
    `order` (all columns if not given) stays.
    """
    known = valid.select(F.col(entity).alias("_known")).distinct()
    rows = df.join(known, df[entity] == known["_known"], "left")
    bad_entity = F.col("_known").isNull()
    bad_period = ~F.coalesce(F.col(period).between(first, last), F.lit(False))
    rows = rows.withColumn("_reason", F.when(bad_entity, "invalid_entity").when(bad_period, "bad_period")).drop("_known")
    by = [F.col(c).asc_nulls_last() for c in (order or df.columns)]
    place = F.row_number().over(W.partitionBy(entity, period, F.col("_reason").isNull()).orderBy(*by))
    return rows.withColumn("_place", place).withColumn("_reason", F.when(F.col("_reason").isNull() & (F.col("_place") > 1), "duplicate_key").otherwise(F.col("_reason"))).drop("_place")


def validate(df: DataFrame, valid: DataFrame, entity: str, period: str, first: int, last: int, source: str = "source", required: Sequence[str] = (), strict: bool = False, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, Report]:
    """The clean rows, the quarantined ones with reason and source, and a report; strict raises on the first failing check."""
    missing = [c for c in (entity, period, *required) if c not in df.columns]
    if missing:
        raise ValidationError(f"{source}: missing columns {missing}")
    rows = checked(df, valid, entity, period, first, last, order)
    reasons = ["invalid_entity", "bad_period", "duplicate_key"]
    counted = rows.groupBy("_reason").agg(F.count(F.lit(1)).alias("n")).collect()
    # Of each reason the ten smallest entities: distinct ones are ranked, so that no task gathers them all.
    bad_names = rows.filter("_reason IS NOT NULL").select("_reason", F.substring(F.col(entity).cast("string"), 1, 40).alias("name")).filter("name IS NOT NULL").distinct()
    named = bad_names.withColumn("_rank", F.row_number().over(W.partitionBy("_reason").orderBy("name"))).filter("_rank <= 10").orderBy("_reason", "name").collect()
    by = {r["_reason"]: r for r in counted}
    failures = {k: by[k]["n"] if k in by else 0 for k in reasons}
    clean_n = by[None]["n"] if None in by else 0
    report = Report(source, sum(failures.values()) + clean_n, clean_n, failures, {k: [r["name"] for r in named if r["_reason"] == k] for k in reasons if k in by})
    if strict and not report.passed:
        first_bad = next(k for k in reasons if failures[k])
        raise ValidationError(f"{source}: {first_bad} in {failures[first_bad]} rows, such as {report.samples.get(first_bad, [])}")
    bad = rows.filter("_reason IS NOT NULL").withColumnRenamed("_reason", "_quarantine_reason").withColumn("_quarantine_source", F.lit(source)).withColumn("_quarantine_at", F.current_timestamp())
    return rows.filter("_reason IS NULL").drop("_reason"), bad, report


def quarantine_counts(df: DataFrame, valid: DataFrame, entity: str, period: str, first: int, last: int, order: Sequence[str] = ()) -> DataFrame:
    rows = checked(df, valid, entity, period, first, last, order)
    return rows.groupBy(F.coalesce("_reason", F.lit("clean")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def write_quarantine(bad: DataFrame, path: str) -> None:
    """Appends quarantined rows, a folder for each source and reason."""
    bad.write.mode("append").partitionBy("_quarantine_source", "_quarantine_reason").parquet(path)


def write_report(spark: SparkSession, report: Report, path: str) -> None:
    """A report as one JSON line and as CSV of its failures, in folders under path, on any file system."""
    spark.createDataFrame([(json.dumps(json.loads(report.to_json()), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/json")
    rows = [(report.source, k, n, n == 0) for k, n in report.failures.items()]
    spark.createDataFrame(rows, "source string, check string, n_failed long, passed boolean").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def gated(stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], df: DataFrame, check: Callable[[str, DataFrame], None]) -> DataFrame:
    """df through the stages in order; check is called with each stage's name and result, and raises to stop."""
    for name, stage in stages:
        df = stage(df)
        check(name, df)
    return df


def require_rows(df: DataFrame, period: str, per_period: int) -> None:
    """Raises unless every period has that many rows."""
    wrong = df.groupBy(period).count().filter(F.col("count") != per_period).limit(20).collect()
    if wrong:
        raise ValidationError(f"rows per period other than {per_period}: { {r[period]: r['count'] for r in wrong} }")


def require_reference(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df, a reference list: raises unless it has that many rows, and in each a key that no other has."""
    n, keys, nulls = df.agg(F.count(F.lit(1)), F.count_distinct(key), F.count_if(F.col(key).isNull())).first()
    if n != rows or keys != rows or nulls:
        raise ValidationError(f"{n} rows, {keys} distinct {key} and {nulls} without one; {rows} wanted of the first two")
    return df


def require_values(df: DataFrame, keys: Sequence[str]) -> None:
    """Raises on a panel with nothing but keys and nulls."""
    values = [c for c in df.columns if c not in keys]
    if not values or not any(df.agg(*(F.count(c).alias(c) for c in values)).first()):
        raise ValidationError("the panel holds no values")


def require_normalised(df: DataFrame, columns: Sequence[str], period: str) -> None:
    """Raises unless each column's least is 0 and largest 1 in each period; groups of one value (all 0.5) are exempt."""
    for c in columns:
        bad = df.groupBy(period).agg(F.min(c).alias("lo"), F.max(c).alias("hi")).filter("lo <> hi AND (abs(lo) > 1e-9 OR abs(hi - 1) > 1e-9)").limit(1).count()
        if bad:
            raise ValidationError(f"{c} isn't scaled to 0 and 1 in each {period}")


def data_dictionary(df: DataFrame) -> DataFrame:
    """column, type, n_missing and pct_missing of each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in df.columns))
    pct = lambda c: F.bround(F.lit(100.0) * (F.col("_n") - F.col(c)) / F.nullif(F.col("_n"), F.lit(0)), 2)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), (F.col("_n") - F.col(c)).alias("n_missing"), pct(c).alias("pct_missing")) for c, t in df.dtypes))
    return counts.select(F.inline(rows))


def check_dictionary(df: DataFrame, documented: Mapping[str, str]) -> DataFrame:
    """column, type, documented type, status and pct_missing of each column of df or of the documentation.

    status: ok, type (differs from the documented one), undocumented, absent (documented only), or empty (no value at all).
    """
    found = data_dictionary(df)
    told = F.create_map(*(F.lit(x) for pair in documented.items() for x in pair)) if documented else F.create_map().cast("map<string,string>")
    rows = found.withColumn("documented", F.element_at(told, F.col("column")))
    status = F.when(F.col("documented").isNull(), "undocumented").when(F.col("type") != F.col("documented"), "type").when(F.col("pct_missing") >= 100, "empty").otherwise("ok")
    rows = rows.select("column", "type", "documented", status.alias("status"), "pct_missing")
    absent = [(c, None, t, "absent", None) for c, t in documented.items() if c not in df.columns]
    schema = "column string, type string, documented string, status string, pct_missing double"
    return rows.union(df.sparkSession.createDataFrame(absent, schema)) if absent else rows


def status_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("task", "status").agg(F.count(F.lit(1)).alias("n"))


def pending_tasks(tasks: DataFrame, log: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """The tasks whose latest entry in the log isn't DONE."""
    latest = log.groupBy(*keys).agg(F.max_by("status", at).alias("_status")).filter("_status = 'DONE'")
    return tasks.join(latest.select(*keys), list(keys), "left_anti")
