"""Null-safe column expressions. ANSI mode raises on bad casts and division by zero; these give null."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
Z95 = 1.959963984540054


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def number(x: Column) -> Column:
    """A string as a double; what isn't a number, NaN included, is null."""
    return nan_to_null(x.try_cast("double"))


def safe_div(x: Column, y: Column) -> Column:
    return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))


def rate(x: Column, denominator: Column, per: float = 100_000.0) -> Column:
    return safe_div(x, denominator) * F.lit(float(per))


def clip_keep_null(x: Column, low: float, high: float) -> Column:
    """x held within bounds; greatest and least alone would skip a null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def normalize_code(code: Column, width: int = 7) -> Column:
    """Trimmed, padded with zeros on the left, never cut."""
    text = F.trim(code.cast("string"))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def name_key(name: Column, group: Column) -> Column:
    """An upper-case name and its group as one key."""
    return F.concat(F.upper(F.trim(name)), F.lit("_"), group)


def prefix_in(code: Column, prefixes: Sequence[str], width: int = 3) -> Column:
    return F.coalesce(F.upper(F.substring(code, 1, width)).isin(*prefixes), F.lit(False))


def recode(x: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value, null where there is none."""
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), x.cast("string"))


def categorise(code: Column, classes: Mapping[str, Sequence[str]], default: str = "unknown") -> Column:
    out = F.lit(default)
    for name, codes in reversed(classes.items()):
        out = F.when(code.isin(*codes), F.lit(name)).otherwise(out)
    return out


def age_years(age: Column, unit: Column) -> Column:
    """Whole years from an age and its unit: 4 years, 3 months, 1 and 2 hours and days; unit 4 and age 0 if missing."""
    unit, age = F.coalesce(unit.try_cast("int"), F.lit(4)), F.coalesce(number(age), F.lit(0.0))
    years = F.when(unit == 4, age).when(unit == 3, age / 12.0).when(unit.isin(1, 2), F.lit(0.0))
    return F.greatest(F.floor(years), F.lit(0)).cast("int")


def band(x: Column, width: int = 5, last: int = 16) -> Column:
    """The number of the fixed-width band [k * width, (k + 1) * width), the last one open."""
    return F.least(F.floor(x / width), F.lit(last)).cast("int")


def band_label(x: Column, width: int = 5, last: int = 16) -> Column:
    k = band(x, width, last)
    low = (k * width).cast("string")
    return F.when(k == last, F.concat(low, F.lit("+"))).otherwise(F.concat(low, F.lit("-"), ((k + 1) * width - 1).cast("string")))


def has_capability(flags: Sequence[Column], counts: Sequence[Column], least: int = 10, every: bool = False) -> Column:
    """Any flag is positive, or the counts add up to `least` (with every: all flags and the sum)."""
    enough = reduce(lambda a, b: a + b, (F.coalesce(number(c.cast("string")), F.lit(0.0)) for c in counts)) >= least
    tests = [*(F.coalesce(number(f.cast("string")) > 0, F.lit(False)) for f in flags), enough]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2.0), 2.0) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2.0)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def present(columns: Sequence[Column]) -> Column:
    """How many of the columns aren't null."""
    return reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))


def row_mean(columns: Sequence[Column]) -> Column:
    """The mean of those that aren't null; null if all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))
    return total / F.nullif(present(columns), F.lit(0))


def geometric_mean(columns: Sequence[Column], offset: float = 0.01) -> Column:
    """exp(mean(ln(x + offset))) - offset over those that aren't null; null if all are."""
    return F.exp(row_mean([F.ln(c + F.lit(offset)) for c in columns])) - F.lit(offset)


def floored_geometric_mean(columns: Sequence[Column], floor: float = 0.001) -> Column:
    """exp(mean(ln(max(x, floor)))) over those that aren't null."""
    return F.exp(row_mean([F.when(c.isNotNull(), F.ln(F.greatest(c, F.lit(floor)))) for c in columns]))


def correlation(x: Column, y: Column) -> Column:
    """An aggregate: Pearson's correlation over the rows that have both; null where one doesn't vary, which corr takes for an error."""
    both = lambda a, b: F.var_pop(F.when(b.isNotNull(), a))
    return F.covar_pop(x, y) / F.nullif(F.sqrt(both(x, y)) * F.sqrt(both(y, x)), F.lit(0.0))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of Wilson's interval within [0, 1]; null without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p, zz = successes.cast("double") / n, F.lit(z * z)
    centre = (p + zz / (n * 2.0)) / (zz / n + 1.0)
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (n * n * 4.0)) / (zz / n + 1.0)
    return clip_keep_null(centre - half, 0, 1), clip_keep_null(centre + half, 0, 1)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def ln_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log1p_floored(x: Column) -> Column:
    """ln(1 + x), of 0 for what is below it; a null stays null."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))


def per_head(total: Column, people: Column, units: float = 1_000.0) -> Column:
    """A total in so many units of money, by people; null without people."""
    return rate(total, people, units)


def rounded(x: Column, digits: int = 6) -> Column:
    """For comparing sums of doubles, whose last digits depend on the partitioning."""
    return F.round(x, digits)


def usd(x: Column, per_unit: float) -> Column | None:
    """x in another currency; None (skip the column) where the price isn't positive."""
    return x / F.lit(float(per_unit)) if per_unit and per_unit > 0 and math.isfinite(per_unit) else None
