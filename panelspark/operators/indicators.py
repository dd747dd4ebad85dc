"""Dimension scores, composites, service indicators and access distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_keep_null, flag, floored_geometric_mean, geometric_mean, haversine_km, present, rate, row_mean, safe_div
from .normalize import minmax_within, winsor_minmax

#: Coordinates of facilities that are sent to all tasks; more are matched by cells.
BROADCAST_FACILITIES = 1_000

#: Coordinates of places whose results are sent to all tasks; more are joined to places by a shuffle.
BROADCAST_SITES = 100_000


@dataclass(frozen=True)
class DimensionSpec:
    """A dimension: its column, an optional denominator and factor, and whether low is good."""

    key: str
    column: str
    denominator: str | None = None
    factor: float = 1.0
    inverted: bool = False


def raw_dimensions(df: DataFrame, specs: Sequence[DimensionSpec]) -> DataFrame:
    """A column for each dimension; one whose column is missing is null."""
    out = {}
    for s in specs:
        if s.column not in df.columns or (s.denominator and s.denominator not in df.columns):
            out[s.key] = F.lit(None).cast("double")
        else:
            out[s.key] = rate(F.col(s.column), F.col(s.denominator), s.factor) if s.denominator else F.col(s.column).cast("double")
    return df.withColumns(out)


def winsorised_composite(df: DataFrame, columns: Sequence[str], inverted: Sequence[str] = (), keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """df with score: the geometric mean, floored, of columns clipped to their percentiles and scaled; inverted ones count as 1 - x.

    Missing columns of a row are left out of its mean; a row without any has no score.
    """
    scaled = winsor_minmax(df.withColumns({f"_w_{c}": F.col(c).cast("double") for c in columns}), [f"_w_{c}" for c in columns], keys)
    parts = [F.lit(1.0) - F.col(f"_w_{c}") if c in inverted else F.col(f"_w_{c}") for c in columns]
    return scaled.withColumn(score, floored_geometric_mean(parts)).drop(*(f"_w_{c}" for c in columns))


def composite_scores(df: DataFrame, specs: Sequence[DimensionSpec], period: str, score: str = "score") -> DataFrame:
    """Dimensions scaled within each period, inverted ones turned, their geometric mean, and how many there are."""
    keys = [s.key for s in specs]
    scaled = minmax_within(raw_dimensions(df, specs), keys, [period], [s.key for s in specs if s.inverted])
    return scaled.withColumns({score: geometric_mean([F.col(k) for k in keys]), "n_dimensions": present([F.col(k) for k in keys])})


def density(count: Column, population: Column, table_is_empty: bool = False) -> Column:
    """Per 100,000; no one counts as none unless the whole table is empty."""
    return F.lit(None).cast("double") if table_is_empty else rate(F.coalesce(count, F.lit(0)), population)


def volume(procedures: Column, population: Column) -> Column:
    return rate(procedures, population)


def mortality(deaths: Column, procedures: Column, least: int = 10) -> Column:
    """A share of procedures; null under `least` of them."""
    return F.when(procedures >= least, safe_div(deaths, procedures))


def mean_cost(cost: Column, procedures: Column) -> Column:
    return F.when(procedures > 0, safe_div(cost, procedures))


def financial_risk(cost: Column, procedures: Column, income: Column) -> Column:
    return F.when((procedures > 0) & (income > 0), safe_div(mean_cost(cost, procedures), income))


def catastrophic(cost: Column, procedures: Column, income: Column, share: float = 0.10) -> Column:
    """1.0 where the mean cost is more than a share of income, else 0.0; null where the risk is."""
    risk = financial_risk(cost, procedures, income)
    return F.when(risk.isNotNull(), F.when(mean_cost(cost, procedures) > F.lit(share) * income, 1.0).otherwise(0.0))


def legacy_dimension(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """The mean of those columns that aren't null, scaled to 0 to 1 over the whole table."""
    return minmax_within(df.withColumn(out, row_mean([F.col(c).cast("double") for c in columns])), [out], [])


def target_flags(df: DataFrame, at_least: Mapping[str, float] = MappingProxyType({}), at_most: Mapping[str, float] = MappingProxyType({})) -> DataFrame:
    """meets_{column}, 1 where the column reaches (or stays within) its target; a null doesn't."""
    tests = {c: F.col(c) >= v for c, v in at_least.items()} | {c: F.col(c) <= v for c, v in at_most.items()}
    return df.withColumns({f"meets_{c}": flag(t) for c, t in tests.items()})


def region_proxy(df: DataFrame, column: str, region: str, proxies: Mapping[str, float], default: float | None = None) -> DataFrame:
    """Nulls of a column filled with their region's value, then with the default."""
    pairs = [F.lit(v) for pair in proxies.items() for v in pair]
    proxy = F.try_element_at(F.create_map(*pairs), F.col(region)) if pairs else F.lit(None).cast("double")
    return df.withColumn(column, F.coalesce(F.col(column), proxy, F.lit(default)))


def people_density(population: Column, area: Column) -> Column:
    return F.when(area > 0, safe_div(population, area))


def covered_share(members: Column, population: Column) -> Column:
    return clip_keep_null(safe_div(members, population), 0, 1)


def _on_sphere(lat: str, lon: str) -> list[Column]:
    p, q = F.radians(F.col(lat)), F.radians(F.col(lon))
    return [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]


def _located(places: DataFrame, facilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    return places.filter("lat IS NOT NULL AND lon IS NOT NULL"), facilities.filter("f_lat IS NOT NULL AND f_lon IS NOT NULL")


def _sites(places: DataFrame, facilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different coordinates of places, and those of facilities with how many are there and the least of these.

    Who shares coordinates shares distances, so that these are worked out once, however many places and facilities there are.
    """
    points = facilities.groupBy("f_lat", "f_lon").agg(F.min("facility").alias("facility"), F.count(F.lit(1)).alias("n"))
    return places.select("lat", "lon").distinct().cache(), points.cache()


def _km() -> Column:
    return haversine_km(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))


def _meet_all(sites: DataFrame, points: DataFrame, radii: Sequence[float]) -> DataFrame:
    pairs = sites.crossJoin(F.broadcast(points)).withColumn("km", _km())
    counts = (F.coalesce(F.sum(F.when(F.col("km") <= r, F.col("n"))), F.lit(0)).alias(f"within_{r:g}") for r in radii)
    return pairs.groupBy("lat", "lon").agg(F.min("km").alias("min_km"), F.min_by("facility", F.struct("km", "facility")).alias("nearest"), *counts)


def _meet_by_cells(sites: DataFrame, points: DataFrame, radii: Sequence[float], first_km: float | None) -> DataFrame:
    if first_km is None:
        first_km = max(2 * 6371.0 / max(points.count(), 1) ** 0.5, 0.1)

    def around(some: DataFrame, radius: float) -> DataFrame:
        width = F.lit(max(radius / 6371.0, 1e-9))
        cell = lambda lat, lon: [F.floor(x / width) for x in _on_sphere(lat, lon)]
        steps = F.array(*(F.array(F.lit(i), F.lit(j), F.lit(k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
        own = F.array(*cell("lat", "lon"))
        wide = some.withColumn("cell", F.explode(F.transform(steps, lambda s: F.zip_with(own, s, lambda a, b: a + b))))
        near = points.withColumn("cell", F.array(*cell("f_lat", "f_lon")))
        return wide.join(near, "cell").withColumn("km", _km()).filter(F.col("km") <= radius)

    found, left, radius = None, sites, first_km
    while found is None or (radius < 41_000 and left.limit(1).count()):
        met = around(left, radius).groupBy("lat", "lon").agg(F.min("km").alias("min_km"), F.min_by("facility", F.struct("km", "facility")).alias("nearest")).cache()
        found = met if found is None else found.union(met)
        left, radius = left.join(met.select("lat", "lon"), ["lat", "lon"], "left_anti"), radius * 2
    for r in radii:
        counts = around(sites, r).groupBy("lat", "lon").agg(F.sum("n").alias(f"within_{r:g}"))
        found = found.join(counts, ["lat", "lon"], "left").na.fill(0, [f"within_{r:g}"])
    return found


def _of_places(places: DataFrame, facilities: DataFrame, sites: DataFrame, found: DataFrame, radii: Sequence[float], how: str) -> DataFrame:
    """What was found for coordinates, by place; a place's own facilities count as at 0 km wherever they are.

    Up to BROADCAST_SITES coordinates are sent to all tasks, so that no task gets all places that share some.
    """
    names = [f"within_{r:g}" for r in radii]
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        found = F.broadcast(found)
    shared = places.join(found, ["lat", "lon"], how).select("place", "min_km", "nearest", *names)
    more = (F.lit(int(r >= 0)) - (_km() <= r).cast("int") for r in radii)  # an own facility within the radius is counted already
    own = _located(places, facilities)[0].join(facilities, F.col("place") == F.col("f_place")).groupBy("place").agg(F.min("facility").alias("nearest"), *(F.sum(m).alias(n) for m, n in zip(more, names, strict=True)))
    both = shared.union(own.select("place", F.lit(0.0).alias("min_km"), "nearest", *names)).repartition("place")  # first, as grouping before it would hold a task's places and save nothing
    return both.groupBy("place").agg(F.min("min_km").alias("min_km"), F.min_by("nearest", F.struct("min_km", "nearest")).alias("nearest"), *(F.sum(n).alias(n) for n in names))


def nearest_facility(places: DataFrame, facilities: DataFrame, radii: Sequence[float] = (), broadcast_rows: int = BROADCAST_FACILITIES) -> DataFrame:
    """place, min_km, nearest facility and the number of facilities within each radius.

    places: place, lat, lon; facilities: facility, f_place, f_lat, f_lon. A place with a facility of its own is at 0 km; one
    without coordinates, or any place if there are no facilities, has nulls. Different coordinates of facilities are counted
    first: few are sent to all tasks, many are met cell by cell (see by_cells).
    """
    located, facilities = _located(places, facilities)
    sites, points = _sites(located, facilities)
    if points.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = _meet_all(sites, points, radii)
    else:
        found = _meet_by_cells(sites, points, radii, None)
    return _of_places(places, facilities, sites, found, radii, "left")


def by_cells(places: DataFrame, facilities: DataFrame, radii: Sequence[float] = (), first_km: float | None = None) -> DataFrame:
    """The same by equi-joins on cells of the unit sphere's cube.

    Coordinates of places meet those of facilities in their own and the 26 cells around it, whose width is the radius looked at.
    Who finds one within that radius is done; the others look twice as far. Radii to count in are looked at once each. The first
    radius, unless given, is what a share of the sphere's surface for each coordinates of facilities comes to.
    """
    located, facilities = _located(places, facilities)
    sites, points = _sites(located, facilities)
    return _of_places(located, facilities, sites, _meet_by_cells(sites, points, radii, first_km), radii, "inner")
