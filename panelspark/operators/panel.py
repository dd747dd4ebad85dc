"""Panels keyed by entity and period: scaffold, source joins, crosswalks, deflation, deduplication and upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import name_key, normalize_code


@dataclass(frozen=True)
class KeySpec:
    """The key columns of a panel."""

    entity: str = "entity"
    period: str = "period"

    @property
    def columns(self) -> list[str]:
        return [self.entity, self.period]


@dataclass(frozen=True)
class SourceSpec:
    """One source: its values, their aliases in the files, and whether it has no period (and so holds for all)."""

    name: str
    values: Sequence[str]
    cross_sectional: bool = False
    monetary: Sequence[str] = ()
    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)


def first_available(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate among the columns, whatever its case."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def canonical_key(df: DataFrame, canonical: str, synonyms: Sequence[str], width: int = 7) -> DataFrame:
    """Renames the first column (in the table's order) that is a synonym, and normalises its codes."""
    if canonical not in df.columns:
        lower = {s.lower() for s in synonyms}
        found = next((c for c in df.columns if c.lower() in lower), None)
        if found is None:
            raise ValueError(f"no column of {sorted(lower)} in {df.columns}")
        df = df.withColumnRenamed(found, canonical)
    return df.withColumn(canonical, normalize_code(F.col(canonical), width))


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keys))


def scaffold(entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Every entity in every period. Periods are a handful of numbers by nature; they are counted before they are sent to all tasks."""
    periods = periods.distinct()
    if periods.count() > 10_000:
        raise ValueError("a scaffold takes 10,000 periods at most")
    return entities.distinct().crossJoin(F.broadcast(periods))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row of each key: the first in an order that the caller states, as file order means nothing here."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_latest(df: DataFrame, keys: Sequence[str], version: str, *ties: str | Column) -> DataFrame:
    return keep_first(df, keys, [F.desc_nulls_last(version), *ties])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def join_source(panel: DataFrame, source: DataFrame, spec: SourceSpec, key: KeySpec, order: Sequence[str | Column] = ()) -> DataFrame:
    """A left join of a source's declared values, one row for each key of the panel.

    Of several rows of a key, the first in `order` stays. A cross-sectional source goes to all periods of its entity. Only
    declared columns are taken, so that a column in two sources is no clash.
    """
    on = [key.entity] if spec.cross_sectional else key.columns
    renamed = {v: first_available(source, [v, *spec.aliases.get(v, ())]) for v in spec.values}
    columns = [(F.col(c) if c else F.lit(None).cast("double")).alias(v) for v, c in renamed.items()]
    kept = keep_first(source.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in on)), on, [*order] or [F.col(c) for c in sorted(source.columns)])
    return panel.join(kept.select(*on, *columns), on, "left")


def assemble(entities: DataFrame, periods: DataFrame, sources: Sequence[tuple[SourceSpec, DataFrame]], key: KeySpec = KeySpec()) -> DataFrame:
    """The scaffold with every source joined on."""
    out = scaffold(entities, periods)
    for spec, source in sources:
        out = join_source(out, source, spec, key)
    return out


def outer_chain(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(on), "outer")
    return out


def crosswalk(df: DataFrame, code: str, period: str, mapping: DataFrame) -> DataFrame:
    """Codes replaced by the mapping's (original, canonical, valid_from), its latest valid row; others stay.

    The mapping is aggregated by code and period before it is joined, so that a row never multiplies.
    """
    wanted = df.select(F.col(code).alias("original"), F.col(period).alias("_period")).distinct()
    found = wanted.join(mapping, "original").filter("valid_from <= _period")
    latest = found.groupBy("original", "_period").agg(F.max(F.struct("valid_from", "canonical")).alias("m")).select(F.col("original").alias(code), F.col("_period").alias(period), F.col("m.canonical").alias("_new"))
    return df.join(latest, [code, period], "left").withColumn(code, F.coalesce("_new", code)).drop("_new")


def chain_index(changes: DataFrame, order: Sequence[str], change: str, start: float = 100.0) -> DataFrame:
    """changes (a row a month, say) with index: `start` times all changes, in per cent, up to the row; a missing change is none."""
    step = F.ln(F.lit(1.0) + F.coalesce(F.col(change), F.lit(0.0)) / 100)
    upto = W.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)  # a row for each period, of which there are few
    return changes.withColumn("index", F.lit(start) * F.exp(F.sum(step).over(upto)))


def annual_rates(rates: DataFrame, date: str, rate: str, units: float = 1.0) -> DataFrame:
    """year, and the mean and the last rate of a series of daily rates, by `units`; nulls are left out."""
    rows = rates.filter(F.col(rate).isNotNull() & F.col(date).isNotNull())
    value = F.col(rate) / F.lit(float(units))
    return rows.groupBy(F.year(date).cast("long").alias("year")).agg(F.avg(value).alias("mean_rate"), F.max_by(value, F.col(date)).alias("last_rate"))


def join_by_name(left: DataFrame, right: DataFrame, left_name: str, left_group: str, right_name: str, right_group: str) -> DataFrame:
    """left with the columns of right whose name, trimmed and in upper case, and group are the same; right has a row for each at most."""
    key = "_name_key"
    named = right.withColumn(key, name_key(F.col(right_name), F.col(right_group).cast("string"))).drop(right_name, right_group)
    return left.withColumn(key, name_key(F.col(left_name), F.col(left_group).cast("string"))).join(named, key, "left").drop(key)


def deflation_factors(index: DataFrame, base: int, year: str = "year", month: str = "month", value: str = "index") -> DataFrame:
    """year and factor: the base year's December index over the year's."""
    december = index.filter(F.col(month) == 12).groupBy(year).agg(F.max(value).alias("_index"))
    at_base = F.max(F.when(F.col(year) == base, F.col("_index"))).over(W.partitionBy(F.lit(1)))
    return december.withColumn("factor", at_base / F.nullif(F.col("_index"), F.lit(0.0))).select(year, "factor")


def deflate(df: DataFrame, columns: Sequence[str], factors: DataFrame, year: str) -> DataFrame:
    """Columns times their year's factor (null without one); the old values stay as {column}_nominal."""
    out = df.join(factors.select(year, F.col("factor").alias("_factor")), year, "left")
    for c in columns:
        if c in df.columns:
            out = out.withColumn(f"{c}_nominal", F.col(c)).withColumn(c, F.col(c) * F.col("_factor"))
    return out.drop("_factor")


def latest_period(df: DataFrame, periods: Sequence[str], independent: bool = False) -> DataFrame:
    """The rows of the latest period: the largest tuple, or (independent) each column's own maximum."""
    if independent:
        latest = df.agg(*(F.max(p).alias(f"_{p}") for p in periods))
    else:
        latest = df.agg(F.max(F.struct(*periods)).alias("m")).select(*(F.col(f"m.{p}").alias(f"_{p}") for p in periods))
    condition = F.lit(True)
    for p in periods:
        condition &= F.col(p) == F.col(f"_{p}")
    return df.join(F.broadcast(latest), condition, "left_semi")  # one row


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """old with new's rows: of a key in both, new's (replace) or old's (ignore) row stays."""
    winners, others = (new, old) if replace else (old, new)
    return winners.unionByName(others.join(winners.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def dictionary_differences(documented: DataFrame, found: DataFrame) -> DataFrame:
    """Names that are only documented, or only found."""
    return documented.subtract(found).withColumn("side", F.lit("documented")).union(found.subtract(documented).withColumn("side", F.lit("found")))
