"""Rollups, descriptive tables, missingness, correlations, standardisation and flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import correlation
from ..functions.quantiles import t975
from .normalize import GROUP_ROWS, percentiles, quantile_bins, with_stats_of

#: Periods that a pivot may have columns for.
MOST_PERIODS = 1_000
#: Rows of a range, on average, whose distinct values one task sorts for ranks.
RANK_ROWS = 200_000


def event_rollup(events: DataFrame, keys: Sequence[str], event: str, deaths: Column, value: str, stay: str) -> DataFrame:
    """Events of each key: how many, deaths, summed value, and mean stay with a missing stay as 0."""
    present = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    return events.filter(present).groupBy(*keys).agg(
        F.count(event).alias("n_events"),
        F.coalesce(F.sum(deaths.cast("long")), F.lit(0)).alias("n_deaths"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_value"),
        F.avg(F.coalesce(F.col(stay), F.lit(0.0))).alias("mean_stay"),
    )


def mortality_rollup(events: DataFrame, keys: Sequence[str], died: Column, digits: int = 3) -> DataFrame:
    """Events, deaths and deaths per hundred, rounded half to even."""
    n, dead = F.count(F.lit(1)), F.count_if(died)
    return events.groupBy(*keys).agg(n.alias("n_events"), dead.alias("n_deaths"), F.bround(F.lit(100.0) * dead / n, digits).alias("mortality_pct"))


def category_counts(df: DataFrame, keys: Sequence[str], column: str, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """All rows, and those of each class of values."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), *(F.count_if(F.col(column).isin(*v)).alias(f"n_{k}") for k, v in classes.items()))


def period_rollup(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in means))


def binary_rates(df: DataFrame, keys: Sequence[str], flags: Mapping[str, str], population: str, per: float = 100_000.0) -> DataFrame:
    """For each flag (a name and its column): how many rows have it, and its rate per so many of the key's largest population."""
    people = F.max(population)
    counts = {name: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)) for name, c in flags.items()}
    rates = [(n.cast("double") / F.nullif(people.cast("double"), F.lit(0.0)) * F.lit(per)).alias(f"{name}_rate") for name, n in counts.items()]
    return df.groupBy(*keys).agg(*(n.alias(f"n_{name}") for name, n in counts.items()), *rates)


def target_gaps(df: DataFrame, rate: str, target: float, entity: str) -> DataFrame:
    """df with gap (target less rate, null stays null) and meets, the widest gaps first; rows without a rate are left out."""
    gap = F.lit(float(target)) - F.col(rate)
    return df.filter(F.col(rate).isNotNull()).withColumns({"gap": gap, "meets": F.coalesce(F.col(rate) >= target, F.lit(False)).cast("int")}).orderBy(F.desc("gap"), entity)


def one_hot(df: DataFrame, column: str, values: Sequence, prefix: str | None = None, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each of the given values; a null is 0 in all."""
    kept = list(values)[1:] if drop_first else values
    return df.withColumns({f"{prefix or column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in kept})


def in_order(df: DataFrame, column: str, order: Sequence[str], *ties: str) -> DataFrame:
    """Rows in the order in which their category is listed; categories that aren't come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), column, *ties)


def weighted_means(df: DataFrame, group: str, weight: str, means: Sequence[str], sums: Sequence[str] = (), entity: str | None = None, parity: bool = False) -> DataFrame:
    """Of each group the weighted means, sums and number of entities.

    Weights of rows whose value is missing don't count; with parity they do, which pulls the mean down.
    """
    w = F.col(weight).cast("double")
    columns = []
    for c in means:
        base = F.sum(w) if parity else F.sum(F.when(F.col(c).isNotNull(), w))
        columns.append(F.coalesce(F.sum(F.col(c) * w) / F.nullif(F.greatest(base, F.lit(0.0)), F.lit(0.0)), F.lit(0.0) if parity else F.lit(None).cast("double")).alias(c))
    columns += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    if entity:
        columns.append(F.countDistinct(entity).alias("n_entities"))
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(*columns)


def standardised_rates(events: DataFrame, population: DataFrame, keys: Sequence[str], stratum: str, per: float = 100_000.0, parity: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """Directly standardised and crude rates of each key, and of each of the columns `within`, whose people are standards of their own.

    events: keys, stratum and n; population: keys, stratum and population. A stratum's weight is its share of all people.
    The crude rate's denominator is everybody; with parity only strata that had events.
    """
    keys = [*keys, *within]
    both = population.groupBy(*keys, stratum).agg(F.sum("population").alias("population")).join(events.groupBy(*keys, stratum).agg(F.sum("n").alias("n")), [*keys, stratum], "left")
    standard = population.groupBy(*within, stratum).agg(F.sum("population").alias("_people"))
    everybody = W.partitionBy(*within) if within else W.partitionBy(F.lit(1))  # a row for each stratum
    standard = standard.withColumn("weight", F.col("_people") / F.sum("_people").over(everybody)).drop("_people")
    n = F.coalesce("n", F.lit(0))
    people = F.sum(F.when(F.col("n").isNotNull(), F.col("population"))) if parity else F.sum("population")
    return both.join(standard, [*within, stratum]).groupBy(*keys).agg(
        F.sum(n / F.nullif(F.col("population").cast("double"), F.lit(0.0)) * F.lit(per) * F.col("weight")).alias("standardised_rate"),
        (F.sum(n) / F.nullif(people.cast("double"), F.lit(0.0)) * F.lit(per)).alias("crude_rate"),
    )


def with_totals(df: DataFrame, keys: Sequence[str], stratum: str, values: Sequence[str], total: str = "T") -> DataFrame:
    """Sums by keys and stratum, and over all strata as the stratum `total`, in one pass."""
    sets = df.groupingSets([[*keys, stratum], list(keys)], *keys, stratum).agg(*(F.sum(v).alias(v) for v in values), F.grouping(stratum).alias("_all"))
    return sets.withColumn(stratum, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(stratum))).drop("_all")


def describe(df: DataFrame, columns: Sequence[str], group: str | None = None, overall: str = "Overall") -> DataFrame:
    """variable, group, n, mean, sd, median, q25, q75, min and max; with a group also a row for all, from one grouping-sets pass."""
    base = [F.lit("all").alias("_group")] if group is None else [F.col(group).cast("string").alias("_group")]
    long = df.select(*base, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot("_group", list(columns), "variable", "value")
    stats = [
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]

    def quartiles(keys: Sequence[str]) -> DataFrame:
        q = percentiles(long, ["value"], [0.25, 0.5, 0.75], keys)
        return q.select(*keys, *(F.col("_q_value")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))))

    if df.count() <= GROUP_ROWS:  # no group is larger: percentiles in the same pass
        stats.append(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("_q"))
        spread = {n: F.col("_q")[i] for i, n in enumerate(("q25", "median", "q75"))}
        if group is None:
            return long.groupBy("variable").agg(*stats).withColumns(spread).drop("_q")
        sets = long.groupingSets([["_group", "variable"], ["variable"]], "_group", "variable").agg(*stats, F.grouping("_group").cast("int").alias("_all")).withColumns(spread)
        name = F.when(F.col("_all") == 1, F.lit(overall)).otherwise(F.col("_group"))
        return sets.select(name.alias("group"), *(c for c in sets.columns if c[0] != "_"))
    if group is None:
        return with_stats_of(long.groupBy("variable").agg(*stats), quartiles(["variable"]), ["variable"])
    sets = long.groupingSets([["_group", "variable"], ["variable"]], "_group", "variable").agg(*stats, F.grouping("_group").cast("int").alias("_all"))
    apart = quartiles(["_group", "variable"]).withColumn("_all", F.lit(0))
    together = quartiles(["variable"]).select(F.lit(None).cast("string").alias("_group"), "variable", "q25", "median", "q75", F.lit(1).alias("_all"))
    sets = with_stats_of(sets, apart.unionByName(together), ["_group", "variable", "_all"])
    name = F.when(F.col("_all") == 1, F.lit(overall)).otherwise(F.col("_group"))
    return sets.select(name.alias("group"), *(c for c in sets.columns if c[0] != "_"))


def with_t_interval(stats: DataFrame) -> DataFrame:
    """se, ci_low and ci_high of rows with n, mean and sd; null where n is under 2."""
    se = F.when(F.col("n") > 1, F.col("sd") / F.sqrt(F.col("n").cast("double")))
    half = t975(F.when(F.col("n") > 1, F.col("n") - 1)) * se
    return stats.withColumns({"se": se, "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def periods(df: DataFrame, column: str, most: int = MOST_PERIODS) -> list:
    """All periods present, in order, as pivots need them; an error if they are more than `most`."""
    found = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} periods")
    return found


def medians_by(df: DataFrame, row: str, column: str, values: Sequence, variable: str) -> DataFrame:
    """A row for each group with its median in each of the given periods."""
    medians = percentiles(df, [variable], [0.5], [row, column]).select(row, column, F.col(f"_q_{variable}")[0].alias("_median"))
    return medians.groupBy(row).pivot(column, list(values)).agg(F.first("_median"))


def missingness(df: DataFrame, columns: Sequence[str], period: str | None = None, handling: Mapping[str, str] | None = None) -> DataFrame:
    """variable (and period), n_total, n_observed, n_missing, pct_missing and handling."""
    ids = [F.col(period)] if period else [F.lit("all").alias("_period")]
    name = period or "_period"
    long = df.select(*ids, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(name, list(columns), "variable", "value")
    out = long.groupBy("variable", name).agg(F.count(F.lit(1)).alias("n_total"), F.count("value").alias("n_observed"))
    how = F.lit("none")
    for variable, text in (handling or {}).items():
        how = F.when(F.col("variable") == variable, F.lit(text)).otherwise(how)
    missing = F.col("n_total") - F.col("n_observed")
    out = out.withColumns({"n_missing": missing, "pct_missing": F.bround(F.lit(100.0) * missing / F.col("n_total"), 2), "handling": F.when(missing == 0, F.lit("complete")).otherwise(how)})
    return out if period else out.drop("_period")


def with_mechanism(missing: DataFrame, declared: Mapping[str, str], sources: Sequence[str] = (), handling: Mapping[str, str] | None = None) -> DataFrame:
    """missingness with mechanism and how each is handled.

    declared names the mechanism of variables by how their names begin (the first that fits counts). Of variables of the
    sources, one without any value is "source_unavailable". Others are "NA" where nothing is missing, else "MAR".
    """
    begins = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.col("variable").startswith(n)) if names else F.lit(False)
    mechanism = F.when(begins(list(sources)) & (F.col("pct_missing") >= 100), "source_unavailable").when(F.col("n_missing") == 0, "NA").otherwise("MAR")
    for prefix, name in reversed(declared.items()):
        mechanism = F.when(F.col("variable").startswith(prefix), name).otherwise(mechanism)
    how = F.lit("left_as_missing")
    for name, text in (handling or {}).items():
        how = F.when(F.col("mechanism") == name, text).otherwise(how)
    return missing.withColumn("mechanism", mechanism).withColumn("handling", how)


def trends(df: DataFrame, period: str, means: Sequence[str] = (), medians: Sequence[str] = (), sums: Sequence[str] = (), distinct: Sequence[str] = ()) -> DataFrame:
    """period, and mean_, median_, sum_ and n_ of the columns of each kind; medians are exact, nulls count in none."""
    kinds = [F.avg(c).alias(f"mean_{c}") for c in means] + [F.sum(c).alias(f"sum_{c}") for c in sums] + [F.count_distinct(c).alias(f"n_{c}") for c in distinct]
    out = df.groupBy(period).agg(*kinds) if kinds else df.select(period).distinct()
    if not medians:
        return out
    found = with_stats_of(out, percentiles(df, medians, [0.5], [period]), [period])
    return found.withColumns({f"median_{c}": F.col(f"_q_{c}")[0] for c in medians}).drop(*(f"_q_{c}" for c in medians))


def missingness_wide(df: DataFrame, columns: Sequence[str], period: str, values: Sequence) -> DataFrame:
    """variable, its missing per cent in each period, and overall."""
    each = missingness(df, columns, period).groupBy("variable").pivot(period, list(values)).agg(F.first("pct_missing"))
    return each.join(missingness(df, columns).select("variable", F.col("pct_missing").alias("overall")), "variable")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x, y and r of each pair of columns, over the rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.struct(correlation(F.col(a), F.col(b)).alias("r"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n")).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{i}`.r").alias("r"), F.col(f"`{i}`.n").alias("n")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(rows))


def _ranks(df: DataFrame, column: str, out: str, parts: int | None = None) -> DataFrame:
    """_v and out: the rank of each distinct value of a column.

    Distinct values with their counts are dealt to ranges of RANK_ROWS rows or so (or to `parts` ranges) and sorted in each; the
    counts of the ranges before are added. Ranges come from a sketch of the rows.
    """
    parts = parts or max(1, -(-df.count() // RANK_ROWS))
    edges = (df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []) if parts > 1 else []
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    part = F.lit(0)
    if edges:
        part = F.array_size(F.filter(F.lit(sorted(set(edges))), lambda e: e < F.col("_v")))
    counts = counts.withColumn("_part", part)
    upto = F.sum("_n").over(W.partitionBy("_part").orderBy("_v")) - F.col("_n") + (F.col("_n") + 1) / 2.0
    if not edges:
        return counts.select("_v", upto.alias(out))
    sizes = counts.groupBy("_part").agg(F.sum("_n").alias("_s"))
    before = sizes.select("_part", (F.sum("_s").over(W.partitionBy(F.lit(1)).orderBy("_part")) - F.col("_s")).alias("_before"))  # a row for each range
    return counts.withColumn("_upto", upto).join(F.broadcast(before), "_part").select("_v", (F.col("_before") + F.col("_upto")).alias(out))


def _ranked(df: DataFrame, column: str, ranks: DataFrame) -> DataFrame:
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def average_ranks(df: DataFrame, column: str, out: str, parts: int | None = None) -> DataFrame:
    """df with ranks in which ties share their mean; nulls have none."""
    return _ranked(df, column, _ranks(df, column, out, parts))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    complete = df.select(x, y).na.drop()
    return _ranked(_ranked(complete, x, _ranks(complete, x, "_rx")), y, _ranks(complete, y, "_ry")).agg(correlation(F.col("_rx"), F.col("_ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x, y, r and n of each pair of columns, by ranks over the rows that have them all."""
    complete = ranked = df.select(*columns).na.drop()
    for i, c in enumerate(columns):
        ranked = _ranked(ranked, c, _ranks(complete, c, f"_r{i}"))
    return correlations(ranked.select(*(F.col(f"_r{i}").alias(c) for i, c in enumerate(columns))), columns)


def quantile_group_means(df: DataFrame, by: str, bins: int, columns: Sequence[str]) -> DataFrame:
    binned = quantile_bins(df, by, bins).filter("bin IS NOT NULL")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns))


def dose_response(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """bin, means of x and y, standard error, n and the normal interval of each quantile bin of x."""
    binned = quantile_bins(df.select(x, y).na.drop(), x, bins)
    out = binned.groupBy("bin").agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("_sd"), F.count(F.lit(1)).alias("n"))
    sem = F.col("_sd") / F.sqrt(F.col("n").cast("double"))
    return out.withColumns({"sem": sem, "ci_low": F.col("mean_y") - 1.96 * sem, "ci_high": F.col("mean_y") + 1.96 * sem}).drop("_sd")


def flows(df: DataFrame, origin: str, destination: str, weight: str | None = None) -> DataFrame:
    """Counts or summed weights of each pair of different places."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(origin) != F.col(destination)).groupBy(F.col(origin).alias("origin"), F.col(destination).alias("destination")).agg(total.alias("flow"))


def top_flows(df: DataFrame, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc("flow"), "origin", "destination").limit(n)


def distance_summary(df: DataFrame, key: str, distance: str, own: Column) -> DataFrame:
    """n, how many stayed, and mean, median, 90th percentile and maximum of the others' distances."""
    away = F.when(~F.coalesce(own, F.lit(False)), F.col(distance))
    q = percentiles(df.select(key, away.alias("_away")), ["_away"], [0.5, 0.9], [key])
    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(own).alias("n_self"),
        (F.lit(100.0) * F.count_if(own) / F.count(F.lit(1))).alias("pct_self"),
        F.avg(away).alias("mean_km"),
        F.max(away).alias("max_km"),
    )
    out = with_stats_of(out, q, [key])
    return out.withColumns({"median_km": F.col("_q__away")[0], "p90_km": F.col("_q__away")[1]}).drop("_q__away")


def top_entities(df: DataFrame, entity: str, value: str, n: int = 10, descending: bool = True) -> DataFrame:
    """The n entities whose best row is best; rows without a value don't count."""
    best = df.filter(F.col(value).isNotNull()).groupBy(entity).agg((F.max if descending else F.min)(value).alias(value))
    return best.orderBy(F.desc(value) if descending else F.asc(value), entity).limit(n)
