"""Queries of fitted models, and the SQL that solves the same equations in another way where SQL can.

Two-way demeaning is alternated in SQL until it stands still, least squares go through orthogonal columns, and intervals of distributions are found
by halving. Queries without SQL have tests against plain numpy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.quantiles import poisson_interval
from ..operators import aggregate as A
from ..operators import indicators as I
from ..operators import models as M
from ..operators import stats as S
from .catalogue import _DIMS, _PANEL, T_QUANTILES, full, panel, query, r, scores, table

_ROUNDS = 14
_RECURSIVE = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _two_way_sql(models: dict[str, tuple[str, str]]) -> str:
    """Fixed effects of cost per procedure on a score, for each model's (score, condition) over the scored panel."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, c.entity, c.period, c.{x} AS x, f.cost / f.procedures AS y FROM cs c JOIN full_panel f USING (entity, period) WHERE c.{x} IS NOT NULL AND f.cost / f.procedures IS NOT NULL AND {condition}" for m, (x, condition) in models.items())
    steps = [f"a0 AS (SELECT *, x AS ex, y AS ey FROM ({rows}))"]
    for k in range(_ROUNDS):
        steps.append(f"b{k} AS (SELECT model, entity, period, x, y, ex - avg(ex) OVER (PARTITION BY model, entity) AS ex, ey - avg(ey) OVER (PARTITION BY model, entity) AS ey FROM a{k})")
        steps.append(f"a{k + 1} AS (SELECT model, entity, period, x, y, ex - avg(ex) OVER (PARTITION BY model, period) AS ex, ey - avg(ey) OVER (PARTITION BY model, period) AS ey FROM b{k})")
    last = f"a{_ROUNDS}"
    return (
        _RECURSIVE(_DIMS)
        + ", "
        + ",\n".join(steps)
        + f""",
fit AS (SELECT model, sum(ex * ey) / sum(ex * ex) AS b, sum(ex * ex) AS xx, count(*) AS n, count(DISTINCT entity) AS g, count(DISTINCT period) AS t FROM {last} GROUP BY model),
r2 AS (SELECT model, 1 - sum(power(ey - b * ex, 2)) / sum(ey * ey) AS r2 FROM {last} JOIN fit USING (model) GROUP BY model),
rw AS (SELECT model, 1 - sum(power(ey - b * ex, 2)) / sum(ey * ey) AS r2_within FROM b0 JOIN fit USING (model) GROUP BY model),
rb AS (SELECT model, 1 - sum(power(my - b * mx, 2)) / sum(my * my) AS r2_between FROM (SELECT model, entity, avg(x) AS mx, avg(y) AS my FROM a0 GROUP BY 1, 2) JOIN fit USING (model) GROUP BY model),
ro AS (SELECT model, 1 - sum(power(y - b * x, 2)) / sum(y * y) AS r2_overall FROM a0 JOIN fit USING (model) GROUP BY model),
u AS (SELECT model, entity, sum(ex * (ey - b * ex)) AS u FROM {last} JOIN fit USING (model) GROUP BY 1, 2),
s AS (SELECT model, sqrt(sum(u * u) * any_value(g) / (any_value(g) - 1)) / any_value(xx) AS se FROM u JOIN fit USING (model) GROUP BY model),
z AS (SELECT model, b, se, b / se AS t_value, n, CAST(n - 1 - g - (t - 1) AS DOUBLE) AS df FROM fit JOIN s USING (model)),
need AS (SELECT DISTINCT df, q FROM z, (VALUES (0.975), (0.995), (0.9995)) v(q)), {T_QUANTILES}
SELECT z.model, 'score' AS term, round(b, 3) AS coef, round(se, 3) AS se, round(t_value, 5) AS t, round(b - t1.t * se, 3) AS ci_low, round(b + t1.t * se, 3) AS ci_high, n,
  CASE WHEN abs(t_value) > t3.t THEN '***' WHEN abs(t_value) > t2.t THEN '**' WHEN abs(t_value) > t1.t THEN '*' ELSE '' END AS stars,
  round(r2, 6) AS r2, round(r2_within, 6) AS r2_within, round(r2_between, 6) AS r2_between, round(r2_overall, 6) AS r2_overall
FROM z JOIN tq t1 ON t1.df = z.df AND t1.q = 0.975 JOIN tq t2 ON t2.df = z.df AND t2.q = 0.995 JOIN tq t3 ON t3.df = z.df AND t3.q = 0.9995
  JOIN r2 USING (model) JOIN rw USING (model) JOIN rb USING (model) JOIN ro USING (model)"""
    )


def _shown(df: DataFrame) -> DataFrame:
    rounded = [r("coef", 3).alias("coef"), r("se", 3).alias("se"), r("t", 5).alias("t"), r("ci_low", 3).alias("ci_low"), r("ci_high", 3).alias("ci_high")]
    return df.select("model", F.lit("score").alias("term"), *rounded, "n", X.stars(F.col("p")).alias("stars"), *(r(c).alias(c) for c in ("r2", "r2_within", "r2_between", "r2_overall")))


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).withColumn("outcome", F.col("cost") / F.col("procedures"))


@query(_two_way_sql({"two-way": ("score", "true")}))
def fixed_effects_model(spark, d):
    fit = S.fixed_effects(_outcome(spark, d), "outcome", ["score"], "entity", "period")
    return _shown(S.result_frame(spark, {"two-way": fit} if fit else {}))


_VARIANTS = {"arithmetic": ("arithmetic", "true"), "four dimensions": ("score", "c.nd >= 4"), "without a year": ("score", "c.period <> 1998")}


@query(_two_way_sql(_VARIANTS))
def sensitivity_regressions(spark, d):
    rows = _outcome(spark, d).select("entity", "period", "score", "arithmetic", "n_dimensions", "outcome").cache()  # scored once for all variants
    variants = {"arithmetic": ("arithmetic", rows), "four dimensions": ("score", rows.filter("n_dimensions >= 4")), "without a year": ("score", rows.filter("period <> 1998"))}
    fits = {m: S.fixed_effects(df, "outcome", [x], "entity", "period") for m, (x, df) in variants.items()}
    rows.unpersist()
    return _shown(S.result_frame(spark, {m: f for m, f in fits.items() if f}))


@query(
    _PANEL
    + """, w AS (SELECT entity, CAST(procedures AS DOUBLE) AS x, cost / 1000 AS y, avg(procedures) OVER (PARTITION BY entity) AS mx, avg(cost / 1000) OVER (PARTITION BY entity) AS my, count(*) OVER (PARTITION BY entity) AS t FROM panel),
f AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS fe, sum((x - mx) * (x - mx)) AS fxx, sum((y - my) * (y - my)) AS fyy, count(*) AS n, count(DISTINCT entity) AS g FROM w),
e AS (SELECT *, (fyy - fe * fe * fxx) / (n - g - 1) AS s2e FROM f),
m AS (SELECT DISTINCT entity, mx, my, t FROM w), b AS (SELECT sum(mx * my) / sum(mx * mx) AS bb, sum(my * my) - sum(mx * my) * sum(mx * my) / sum(mx * mx) AS rss, count(*) / sum(1.0 / t) AS harmonic FROM m),
v AS (SELECT *, greatest(0, rss / (g - 1) - s2e / harmonic) AS s2u FROM e, b),
q AS (SELECT x - (1 - sqrt(s2e / (s2e + t * s2u))) * mx AS qx, y - (1 - sqrt(s2e / (s2e + t * s2u))) * my AS qy FROM w, v),
re AS (SELECT sum(qx * qy) / sum(qx * qx) AS re, sum(qx * qx) AS rxx, (sum(qy * qy) - sum(qx * qy) * sum(qx * qy) / sum(qx * qx)) / (count(*) - 1) AS s2r FROM q),
h AS (SELECT greatest(0, (fe - re) * (fe - re) / (s2e / fxx - s2r / rxx)) AS statistic FROM v, re)
SELECT round(statistic, 5) AS statistic, 1 AS df, round(1 - sqrt(statistic) / 3000 * sqrt(2 / pi()) * list_sum(list_transform(range(0, 1001), lambda i: CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(sqrt(statistic) * i / 1000, 2) / 2))), 6) AS p FROM h"""
)
def hausman_test(spark, d):
    found = S.hausman(panel(spark, d).withColumn("x", F.col("procedures").cast("double")).withColumn("y", F.col("cost") / 1000), "y", ["x"], "entity")
    rows = spark.createDataFrame([(found["statistic"], found["df"], found["p"])], "statistic double, df int, p double")
    return rows.select(r("statistic", 5).alias("statistic"), "df", r("p").alias("p"))


def _orthogonal(name: str, rows: str, degree: int, term: int) -> list[str]:
    """Common tables in which x's powers up to degree, the term last, are made orthogonal one after the other, and y's residual; the
    last, called name, has their columns v0, ..., v{degree} and y."""
    order = [k for k in range(degree + 1) if k != term] + [term]
    out = [f"{name}_0 AS (SELECT " + ", ".join(f"power(x, {k}) AS v{i}" for i, k in enumerate(order)) + f", y, y AS y0 FROM {rows})"]
    for i in range(degree + 1):
        kept = [f"v{j}" for j in range(i + 1)]
        shifted = [f"{c} - v{i} * sum({c} * v{i}) OVER () / sum(v{i} * v{i}) OVER () AS {c}" for c in [*(f"v{j}" for j in range(i + 1, degree + 1)), "y"]]
        out.append(f"{name}_{i + 1} AS (SELECT {', '.join([*kept, *shifted])}, y0 FROM {name}_{i})")
    return out


def _polynomial_sql(degrees: tuple[int, ...]) -> tuple[str, str]:
    """Common tables and the union of every degree's terms: model, term, coef, se, n, df, r2."""
    tables, parts = [], []
    for degree in degrees:
        for term in range(degree + 1):
            name, last = f"p{degree}{term}", f"v{degree}"
            tables += _orthogonal(name, "xy", degree, term)
            squares = ", ".join(f"sum(v{i} * v{i}) OVER () AS s{i}" for i in range(degree + 1))
            leverage = " + ".join(f"v{i} * v{i} / s{i}" for i in range(degree + 1))
            label = ["const", "x", "x^2", "x^3"][term]
            parts.append(
                f"SELECT 'degree {degree}' AS model, '{label}' AS term, sum({last} * y0) / sum({last} * {last}) AS coef, sqrt(sum(power({last} * y / (1 - h), 2))) / sum({last} * {last}) AS se, count(*) AS n, CAST(count(*) - {degree + 1} AS DOUBLE) AS df, 1 - sum(y * y) / (count(*) * var_pop(y0)) AS r2 FROM (SELECT *, {leverage} AS h FROM (SELECT *, {squares} FROM {name}_{degree + 1}))"
            )
    return ", ".join(tables), " UNION ALL ".join(parts)


_TABLES, _TERMS = _polynomial_sql((1, 2, 3))


@query(
    _RECURSIVE(_PANEL)
    + f""", xy AS (SELECT procedures / 100.0 AS x, cost / 1e7 AS y FROM panel), {_TABLES}, terms AS ({_TERMS}), need AS (SELECT DISTINCT df, 0.975 AS q FROM terms), {T_QUANTILES}
SELECT model, term, round(coef, 5) AS coef, round(se, 5) AS se, round(coef - t * se, 4) AS ci_low, round(coef + t * se, 4) AS ci_high, n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / terms.df, 6) AS r2_adjusted FROM terms JOIN tq USING (df)"""
)
def polynomial_fit(spark, d):
    rows = panel(spark, d).select((F.col("procedures") / 100.0).alias("x"), (F.col("cost") / 1e7).alias("y"))
    out = S.result_frame(spark, {f"degree {k}": S.polynomial(rows, "y", "x", k) for k in (1, 2, 3)})
    return out.select("model", "term", r("coef", 5).alias("coef"), r("se", 5).alias("se"), r("ci_low", 4).alias("ci_low"), r("ci_high", 4).alias("ci_high"), "n", r("r2").alias("r2"), r("r2_adjusted").alias("r2_adjusted"))


_CUBIC, _CUBIC_TERMS = _polynomial_sql((3,))


@query(
    _PANEL
    + f""", xy AS (SELECT procedures / 100.0 AS x, cost / 1e7 AS y FROM panel), {_CUBIC}, terms AS ({_CUBIC_TERMS}),
c AS (SELECT max(coef) FILTER (WHERE term = 'const') AS c0, max(coef) FILTER (WHERE term = 'x') AS c1, max(coef) FILTER (WHERE term = 'x^2') AS c2, max(coef) FILTER (WHERE term = 'x^3') AS c3 FROM terms),
e AS (SELECT list_distinct(quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS q FROM xy), b AS (SELECT CAST(greatest(len(list_filter(q, lambda a: a < x)) - 1, 0) AS INTEGER) AS bin, x, y FROM xy, e), m AS (SELECT bin, avg(x) AS x, avg(y) AS y, count(*) AS n FROM b GROUP BY bin)
SELECT bin, n, round(x, 6) AS mean_x, round(y, 6) AS mean_y, round(c0 + c1 * x + c2 * x * x + c3 * x * x * x, 5) AS fitted FROM m, c"""
)
def dose_response_cubic(spark, d):
    rows = panel(spark, d).select((F.col("procedures") / 100.0).alias("x"), (F.col("cost") / 1e7).alias("y"))
    fitted = S.evaluate(S.polynomial(rows, "y", "x", 3), {"x": F.col("mean_x"), "x^2": F.col("mean_x") ** 2, "x^3": F.col("mean_x") ** 3})
    return A.dose_response(rows, "x", "y", 5).select("bin", "n", r("mean_x").alias("mean_x"), r("mean_y").alias("mean_y"), r(fitted, 5).alias("fitted"))


@query(
    _RECURSIVE(_PANEL)
    + """, k AS (SELECT DISTINCT deaths AS k FROM panel),
cdf(k, side, lo, hi, step) AS (
  SELECT k, side, CAST(0 AS DOUBLE), k + 12 * sqrt(k + 1.0) + 12, 0 FROM k, (VALUES (0), (1)) v(side) UNION ALL
  SELECT k, side, CASE WHEN below > target THEN mid ELSE lo END, CASE WHEN below > target THEN hi ELSE mid END, step + 1 FROM (
    SELECT k, side, lo, hi, step, (lo + hi) / 2 AS mid, CASE WHEN side = 0 THEN 0.975 ELSE 0.025 END AS target,
      list_sum(list_transform(range(0, k + side), lambda i: exp(i * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(i + 1.0)))) AS below
    FROM cdf WHERE step < 70)),
b AS (SELECT k, CASE WHEN k = 0 THEN 0 ELSE max(hi) FILTER (WHERE side = 0) END AS low, max(hi) FILTER (WHERE side = 1) AS high FROM cdf WHERE step = 70 GROUP BY k)
SELECT entity, period, deaths, round(low / population * 100000, 4) AS low, round(high / population * 100000, 4) AS high FROM full_panel JOIN b ON k = deaths"""
)
def poisson_intervals(spark, d):
    rows = full(spark, d).withColumn("b", poisson_interval(F.col("deaths")))
    return rows.select("entity", "period", "deaths", r(X.rate(F.col("b.low"), F.col("population")), 4).alias("low"), r(X.rate(F.col("b.high"), F.col("population")), 4).alias("high"))


def _mean_cost(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations' mean order value, and the edges between neighbouring keys."""
    values = panel(spark, d).groupBy(F.col("entity").alias("id")).agg((F.sum("cost") / F.sum("procedures")).alias("value"))
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    return values, ids.select("src", F.explode(F.array(F.col("src") - 1, F.col("src") + 1)).alias("dst"), F.lit(1.0).alias("w"))


@query(
    _PANEL
    + """, v AS (SELECT entity AS id, sum(cost) / sum(procedures) AS value FROM panel GROUP BY 1), z AS (SELECT id, value - (SELECT avg(value) FROM v) AS z FROM v),
w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM (SELECT a.id AS src, b.id AS dst FROM z a JOIN z b ON abs(a.id - b.id) = 1)),
place AS (SELECT z, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':values'), id) AS k FROM z),
node AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY md5(CAST(id AS VARCHAR) || ':7:' || CAST(p AS VARCHAR)), id) AS k FROM z, range(1, 100) t(p)),
drawn AS (SELECT p, id, z FROM node JOIN place USING (k) UNION ALL SELECT 0, id, z FROM z),
i AS (SELECT a.p, (SELECT count(*) FROM z) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z) AS i FROM w JOIN drawn a ON a.id = src JOIN drawn b ON b.id = dst AND a.p = b.p GROUP BY 1),
o AS (SELECT i AS morans_i FROM i WHERE p = 0), t AS (SELECT any_value(morans_i) AS morans_i, avg(i) AS expected, stddev_pop(i) AS sd, count(*) FILTER (WHERE i >= morans_i) AS larger FROM i, o WHERE p > 0)
SELECT round(morans_i, 6) AS morans_i, round(expected, 6) AS expected, round((morans_i - expected) / sd, 5) AS z, round((least(larger, 99 - larger) + 1) / 100.0, 6) AS p,
  CASE WHEN (least(larger, 99 - larger) + 1) / 100.0 >= 0.05 THEN 'no significant autocorrelation' WHEN morans_i > 0 THEN 'positive spatial autocorrelation' ELSE 'negative spatial autocorrelation' END AS interpretation FROM t"""
)
def morans_permutation_test(spark, d):
    found = S.with_interpretation(S.morans_test(*_mean_cost(spark, d)))
    return found.select(r("morans_i").alias("morans_i"), r("expected").alias("expected"), r("z", 5).alias("z"), r("p").alias("p"), "interpretation")


@query()
def double_machine_learning(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.month("o_orderdate").cast("double").alias("m"), (F.col("o_custkey") % 100).cast("double").alias("x"), F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 13).cast("double").alias("treatment"))
    found = M.double_ml(rows, "y", "treatment", ["m", "x"], ["o_orderkey"])
    return spark.createDataFrame([(found["effect"], found["se"], found["n"])] if found else [], "effect double, se double, n long")


@query(
    """WITH c AS (SELECT CAST(s_nationkey AS BIGINT) AS entity, s_suppkey % 4 = 1 OR s_suppkey % 6 = 1 AS able, s_acctbal > 5000 AS rich FROM supplier), p AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, count(*) AS population FROM customer GROUP BY 1),
g AS (SELECT entity, count(*) FILTER (WHERE able) AS n_able, count(*) FILTER (WHERE rich) AS n_rich, max(population) AS population FROM c LEFT JOIN p USING (entity) GROUP BY 1)
SELECT entity, n_able, n_rich, round(n_able / CAST(population AS DOUBLE) * 100000, 6) AS able_rate, round(n_rich / CAST(population AS DOUBLE) * 100000, 6) AS rich_rate, round(5000 - n_able / CAST(population AS DOUBLE) * 100000, 6) AS gap, CASE WHEN n_able / CAST(population AS DOUBLE) * 100000 >= 5000 THEN 1 ELSE 0 END AS meets FROM g WHERE population > 0"""
)
def capability_rates_and_gap(spark, d):
    key = F.col("s_suppkey")
    facilities = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("entity"), X.has_capability([(key % 4 == 1).cast("int"), (key % 6 == 1).cast("int")], [F.lit(0)]).alias("able"), (F.col("s_acctbal") > 5000).alias("rich"))
    people = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("population"))
    rates = A.binary_rates(facilities.join(people, "entity", "left"), ["entity"], {"able": "able", "rich": "rich"}, "population")
    return A.target_gaps(rates, "able_rate", 5000, "entity").select("entity", "n_able", "n_rich", r("able_rate").alias("able_rate"), r("rich_rate").alias("rich_rate"), r("gap").alias("gap"), "meets")


@query("""WITH b AS (SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(c_custkey % 5 AS INTEGER) AS band, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)
SELECT region, band, CASE WHEN grouping(sex) = 1 THEN 'T' ELSE sex END AS sex, count(o_orderkey) AS n FROM b GROUP BY GROUPING SETS ((region, band, sex), (region, band))""")
def strata_with_totals(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("region"))
    people = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("region", (F.col("c_custkey") % 5).cast("int").alias("band"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"), "c_custkey")
    orders = table(spark, d, "orders").select("o_custkey", F.lit(1).cast("long").alias("n"))
    return A.with_totals(people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["n"]), ["region", "band"], "sex", ["n"]).select("region", "band", "sex", "n")


@query(
    """WITH b AS (SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(c_custkey % 5 AS INTEGER) AS band, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
pop AS (SELECT region, band, CASE WHEN grouping(sex) = 1 THEN 'T' ELSE sex END AS sex, count(*) AS population FROM b GROUP BY GROUPING SETS ((region, band, sex), (region, band))),
ev AS (SELECT region, band, CASE WHEN grouping(sex) = 1 THEN 'T' ELSE sex END AS sex, count(*) AS n FROM b JOIN orders ON o_custkey = c_custkey GROUP BY GROUPING SETS ((region, band, sex), (region, band))),
w AS (SELECT sex, band, sum(population) / sum(sum(population)) OVER (PARTITION BY sex) AS weight FROM pop GROUP BY 1, 2)
SELECT region, sex, round(sum(coalesce(n, 0) / CAST(population AS DOUBLE) * 100000 * weight), 4) AS standardised_rate, round(sum(coalesce(n, 0)) / CAST(sum(population) AS DOUBLE) * 100000, 4) AS crude_rate FROM pop LEFT JOIN ev USING (region, band, sex) JOIN w USING (sex, band) GROUP BY 1, 2"""
)
def standardised_rates_by_sex(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("region"))
    people = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("region", (F.col("c_custkey") % 5).cast("int").alias("band"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"), "c_custkey", F.lit(1).cast("long").alias("population"))
    counts = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("region", "band", "sex", F.lit(1).cast("long").alias("n"))
    counts, population = (A.with_totals(df, ["region", "band"], "sex", [c]) for df, c in ((counts, "n"), (people, "population")))
    out = A.standardised_rates(counts, population, ["region"], "band", within=["sex"])
    return out.select("region", "sex", r("standardised_rate", 4).alias("standardised_rate"), r("crude_rate", 4).alias("crude_rate"))


_RANKS = "SELECT * FROM (SELECT {}) ".format(", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_tax")) + " FROM lineitem")


@query(f"WITH k AS ({_RANKS}) " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM k" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))))
def spearman_pairs(spark, d):
    return A.spearman_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("x", "y", r("r").alias("r"), "n")


@query(
    _DIMS
    + """, s AS (SELECT CAST(s_nationkey AS BIGINT) AS entity, count(*) AS facilities FROM supplier GROUP BY 1), base AS (SELECT c.*, f.procedures, f.deaths, f.cost, f.population, f.income, facilities, CAST(n_regionkey AS BIGINT) AS region FROM cs c JOIN full_panel f USING (entity, period) JOIN nation ON n_nationkey = entity LEFT JOIN s USING (entity)),
q AS (SELECT period, quantile_cont(population / 10.0, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM base GROUP BY 1)
SELECT entity, base.period, region, round(score, 6) AS score, round(facilities / CAST(population AS DOUBLE) * 100000, 6) AS facility_density, round(procedures / CAST(population AS DOUBLE) * 100000, 6) AS volume, round(CASE WHEN procedures >= 10 THEN deaths / CAST(procedures AS DOUBLE) END, 6) AS mortality,
  round(CASE WHEN procedures > 0 AND income > 0 THEN cost / procedures / income END, 6) AS risk, round(coalesce(d2, CASE region WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE 0.5 END), 6) AS price_or_proxy, round(population / 10.0, 6) AS people_density,
  CAST(greatest(len(list_filter(list_distinct(e), lambda a: a < population / 10.0)) - 1, 0) AS INTEGER) AS density_quintile,
  CASE WHEN procedures / CAST(population AS DOUBLE) * 100000 >= 150000 THEN 1 ELSE 0 END AS meets_volume, CASE WHEN coalesce(CASE WHEN procedures >= 10 THEN deaths / CAST(procedures AS DOUBLE) END <= 0.45, false) THEN 1 ELSE 0 END AS meets_mortality,
  CASE WHEN region = 0 THEN 1 ELSE 0 END AS region_0, CASE WHEN region = 1 THEN 1 ELSE 0 END AS region_1
FROM base JOIN q ON q.period = base.period"""
)
def whole_panel(spark, d):
    """The scored panel with its region, five joined sources, indicators, targets, density quintile by period and region dummies, in one plan."""
    from ..operators import normalize as N

    region = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity"), F.col("n_regionkey").cast("long").alias("region"))
    facilities = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("facilities"))
    rows = scores(spark, d).join(region, "entity").join(facilities, "entity", "left")
    p, n, c, i = (F.col(x) for x in ("procedures", "population", "cost", "income"))
    rows = rows.withColumns({"facility_density": X.rate(F.col("facilities"), n), "volume": I.volume(p, n), "mortality": I.mortality(F.col("deaths"), p), "risk": I.financial_risk(c, p, i), "people_density": I.people_density(n, F.lit(10.0)), "price_or_proxy": F.col("d2"), "zone": F.col("region").cast("string")})
    rows = I.region_proxy(rows, "price_or_proxy", "zone", {"0": 0.1, "1": 0.2}, 0.5)
    rows = I.target_flags(rows, {"volume": 150000}, {"mortality": 0.45})
    rows = A.one_hot(N.quantile_bins(rows, "people_density", 5, ["period"], "density_quintile"), "region", [0, 1])
    shown = ("score", "facility_density", "volume", "mortality", "risk", "price_or_proxy", "people_density")
    return rows.select("entity", "period", "region", *(r(x).alias(x) for x in shown), "density_quintile", "meets_volume", "meets_mortality", "region_0", "region_1")


@query(_PANEL + "SELECT entity, period, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS legacy FROM (SELECT entity, period, (procedures + deaths) / 2.0 AS v FROM panel)")
def legacy_dimension(spark, d):
    return I.legacy_dimension(panel(spark, d), ["procedures", "deaths"], "legacy").select("entity", "period", r("legacy").alias("legacy"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counts_in_listed_order(spark, d):
    kinds = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return A.in_order(kinds, "event_type", ["view", "click", "purchase"])
