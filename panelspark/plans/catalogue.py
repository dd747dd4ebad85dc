"""Every query by name, and the DuckDB SQL that gives the same rows.

The operators take key and column names; here they are bound to a star schema: nations are entities in regions, order years
are periods, orders are events, customers people and professionals, suppliers facilities. Places on the map are made up
from keys by arithmetic. Sums of doubles are rounded, as their last digits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregate as A
from ..operators import contiguity as C
from ..operators import indicators as I
from ..operators import normalize as N
from ..operators import panel as P
from ..operators import quality as Q
from ..operators import stats as S
from ..sources import html_tables as H

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def year(c: str) -> Column:
    return F.year(c).cast("long")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's nation as entity and year as period."""
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("entity"))
    return table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("entity", year("o_orderdate").alias("period"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """entity, period, procedures, deaths and cost."""
    return events(spark, d).groupBy("entity", "period").agg(F.count(F.lit(1)).alias("procedures"), F.count_if(F.col("o_orderstatus") == "F").alias("deaths"), F.sum("o_totalprice").alias("cost"))


def people(spark: SparkSession, d: str) -> DataFrame:
    """entity, population and income."""
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("population"), F.avg(F.greatest("c_acctbal", F.lit(0.0))).alias("income"))


def full(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).join(people(spark, d), "entity", "left")


_PANEL = """WITH ev AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(year(o_orderdate) AS BIGINT) AS period, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
panel AS (SELECT entity, period, count(*) AS procedures, count(*) FILTER (WHERE o_orderstatus = 'F') AS deaths, sum(o_totalprice) AS cost FROM ev GROUP BY 1, 2),
people AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, count(*) AS population, avg(greatest(c_acctbal, 0.0)) AS income FROM customer GROUP BY 1),
full_panel AS (SELECT p.*, population, income FROM panel p LEFT JOIN people USING (entity))
"""

#: Quantiles t of Student's distribution for the rows of need (df, q): the density's integral by Simpson's rule, halved 60 times.
T_QUANTILES = """tb(df, q, lo, hi, k) AS (
  SELECT df, q, CAST(0 AS DOUBLE), CAST(13 AS DOUBLE), 0 FROM need UNION ALL
  SELECT df, q, CASE WHEN area < q - 0.5 THEN mid ELSE lo END, CASE WHEN area < q - 0.5 THEN hi ELSE mid END, k + 1 FROM (
    SELECT df, q, lo, hi, k, (lo + hi) / 2 AS mid, (lo + hi) / 2 / 600 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
      * list_sum(list_transform(range(0, 201), lambda i: CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power((lo + hi) / 2 * i / 200, 2) / df, -(df + 1) / 2))) AS area
    FROM tb WHERE k < 60)),
tq AS (SELECT df, q, hi AS t FROM tb WHERE k = 60)"""

#: Years of orders and shipments in the tables; a pivot has a column for each.
_ORDER_YEARS = range(1995, 2002)
_SHIP_YEARS = range(1995, 2002)

_SPECS = [
    I.DimensionSpec("d1", "procedures", "population", 1000.0),
    I.DimensionSpec("d2", "mean_price"),
    I.DimensionSpec("d3", "deaths", "procedures", 1.0, inverted=True),
    I.DimensionSpec("d4", "income"),
]

_DIMS = (
    _PANEL
    + """, raw AS (SELECT entity, period, procedures / CAST(nullif(population, 0) AS DOUBLE) * 1000 AS d1, CASE WHEN procedures >= 80 THEN cost / procedures END AS d2,
  deaths / CAST(nullif(procedures, 0) AS DOUBLE) AS d3, income AS d4 FROM full_panel),
mm AS (SELECT *, min(d1) OVER w AS l1, max(d1) OVER w AS h1, min(d2) OVER w AS l2, max(d2) OVER w AS h2, min(d3) OVER w AS l3, max(d3) OVER w AS h3, min(d4) OVER w AS l4, max(d4) OVER w AS h4 FROM raw WINDOW w AS (PARTITION BY period)),
sc AS (SELECT entity, period,
  CASE WHEN d1 IS NULL THEN NULL WHEN h1 = l1 THEN 0.5 ELSE (d1 - l1) / (h1 - l1) END AS d1, CASE WHEN d2 IS NULL THEN NULL WHEN h2 = l2 THEN 0.5 ELSE (d2 - l2) / (h2 - l2) END AS d2,
  1 - CASE WHEN d3 IS NULL THEN NULL WHEN h3 = l3 THEN 0.5 ELSE (d3 - l3) / (h3 - l3) END AS d3, CASE WHEN d4 IS NULL THEN NULL WHEN h4 = l4 THEN 0.5 ELSE (d4 - l4) / (h4 - l4) END AS d4 FROM mm),
cs AS (SELECT *, (d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT + (d4 IS NOT NULL)::INT AS nd,
  exp((coalesce(ln(d1 + 0.01), 0) + coalesce(ln(d2 + 0.01), 0) + coalesce(ln(d3 + 0.01), 0) + coalesce(ln(d4 + 0.01), 0)) / nullif((d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT + (d4 IS NOT NULL)::INT, 0)) - 0.01 AS score,
  (coalesce(d1, 0) + coalesce(d2, 0) + coalesce(d3, 0) + coalesce(d4, 0)) / nullif((d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT + (d4 IS NOT NULL)::INT, 0) AS arithmetic FROM sc)
"""
)


def scores(spark: SparkSession, d: str) -> DataFrame:
    rows = full(spark, d).withColumn("mean_price", F.when(F.col("procedures") >= 80, F.col("cost") / F.col("procedures")))
    out = I.composite_scores(rows, _SPECS, "period")
    return out.withColumn("arithmetic", X.row_mean([F.col(s.key) for s in _SPECS]))


@query(_DIMS + "SELECT entity, period, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3, round(d4, 6) AS d4, round(score, 6) AS score, CAST(nd AS INTEGER) AS n_dimensions FROM cs")
def composite_score(spark, d):
    return scores(spark, d).select("entity", "period", *(r(s.key).alias(s.key) for s in _SPECS), r("score").alias("score"), "n_dimensions")


@query(_DIMS + "SELECT period, round(avg(arithmetic), 6) AS mean_arithmetic, round(avg(score), 6) AS mean_score, count(*) AS n FROM cs WHERE nd >= 4 GROUP BY period")
def sensitivity_variants(spark, d):
    rows = scores(spark, d).filter("n_dimensions >= 4")
    return rows.groupBy("period").agg(r(F.avg("arithmetic")).alias("mean_arithmetic"), r(F.avg("score")).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query(
    _PANEL
    + """, w AS (SELECT quantile_cont(cost, 0.01) AS lo, quantile_cont(cost, 0.99) AS hi, quantile_cont(procedures, 0.01) AS lp, quantile_cont(procedures, 0.99) AS hp FROM panel)
SELECT entity, period, round(exp((ln(greatest((least(greatest(cost, lo), hi) - lo) / (hi - lo), 0.001)) + ln(greatest((least(greatest(procedures, lp), hp) - lp) / (hp - lp), 0.001))) / 2), 6) AS score FROM panel, w"""
)
def winsorised_composite(spark, d):
    rows = N.winsor_minmax(panel(spark, d).withColumn("procedures", F.col("procedures").cast("double")), ["cost", "procedures"])
    return rows.select("entity", "period", r(X.floored_geometric_mean([F.col("cost"), F.col("procedures")])).alias("score"))


@query("""WITH y AS (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS period, o_totalprice AS v FROM orders), w AS (SELECT period, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM y GROUP BY 1)
SELECT o_orderkey, period, round(CASE WHEN hi > lo THEN (least(greatest(v, lo), hi) - lo) / (hi - lo) ELSE v END, 6) AS v FROM y JOIN w USING (period)""")
def winsor_minmax_year(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", year("o_orderdate").alias("period"), F.col("o_totalprice").alias("v"))
    return N.winsor_minmax(rows, ["v"], ["period"]).select("o_orderkey", "period", r("v").alias("v"))


#: Areas stand in a row of so many; an area's number is its key.
_WIDE = 37
_NEAR = f"abs(a.k % {_WIDE} - b.k % {_WIDE}) <= 1 AND abs(a.k // {_WIDE} - b.k // {_WIDE}) <= 1 AND a.k <> b.k"


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    """Corners of square areas, one for each customer, but for every fifth, so that there are gaps."""
    k = F.col("c_custkey")
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0.0, 0.1) for j in (0.0, 0.1))))
    return table(spark, d, "customer").filter(k % 5 != 0).select(k.alias("area"), corner.alias("c")).select("area", ((F.col("area") % _WIDE) * 0.1 + F.col("c.i")).alias("x"), (F.floor(F.col("area") / _WIDE) * 0.1 + F.col("c.j")).alias("y"))


@query(f"WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) SELECT a.k AS src, b.k AS dst, CAST(1 AS DOUBLE) AS w FROM c a JOIN c b ON {_NEAR}")
def queen_contiguity(spark, d):
    return C.queen(cells_of(spark, d))


@query(f"""WITH v AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0), z AS (SELECT k, v - (SELECT avg(v) FROM v) AS z FROM v),
w AS (SELECT a.k AS src, b.k AS dst, 1.0 / count(*) OVER (PARTITION BY a.k) AS w FROM z a JOIN z b ON {_NEAR})
SELECT (SELECT count(*) FROM z) AS n, round((SELECT count(*) FROM z) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS morans_i FROM w JOIN z a ON src = a.k JOIN z b ON dst = b.k""")
def contiguous_morans_i(spark, d):
    values = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return S.morans_i(values, C.queen(cells_of(spark, d))).select("n", r("morans_i").alias("morans_i"))


@query("""WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS region, n_name, CAST(count(*) AS VARCHAR) AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, n_regionkey),
g AS (SELECT region, k, 0 AS c, CAST(region AS VARCHAR) AS text FROM c UNION ALL SELECT region, k, 1, n_name FROM c UNION ALL SELECT region, k, 2, n FROM c
UNION ALL SELECT region, 0, c, CASE c WHEN 0 THEN 'Region' ELSE 'Nation & customers' END FROM (SELECT DISTINCT region FROM c), (VALUES (0), (1), (2)) t(c))
SELECT region, CAST(k AS INTEGER) AS "row", c AS "column", text, k = 0 AS header FROM g""")
def html_table_cells(spark, d):
    """Cells of tables that pages made from nations hold, with a region that spans its nations' rows and a heading over two columns; pages of the web table have none."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("region"))
    counts = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("region", "n_name").agg(F.count(F.lit(1)).alias("n"))
    lines = counts.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("n_name", "n"))).alias("rows"))
    first = F.concat(F.lit("<td rowspan='"), F.size("rows").cast("string"), F.lit("'>"), F.col("region").cast("string"), F.lit("</td>"))
    body = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), F.lit("<td>"), x["n_name"], F.lit("<td> "), x["n"].cast("string"), F.lit("\n</tr>"))), "")
    page = F.concat(F.lit("<p>text<table><tr><th>Region<th colspan=2>Nation &amp;<br>customers</tr>"), body, F.lit("</table>"))
    return H.scan(lines.select("region", page.alias("html")).union(table(spark, d, "pages").select("page_id", "html")), "region").select("region", "row", "column", "text", "header")


_FIVE = ("access", "density", "volume", "mortality", "burden")


@query(
    _PANEL
    + """, fac AS (SELECT CAST(s_nationkey AS BIGINT) AS entity, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 0) AS open FROM supplier GROUP BY 1),
v AS (SELECT entity, period, open / CAST(n AS DOUBLE) AS access, n / CAST(nullif(population, 0) AS DOUBLE) * 100000 AS density, procedures / CAST(nullif(population, 0) AS DOUBLE) * 100000 AS volume,
  CASE WHEN procedures >= 80 THEN deaths / CAST(procedures AS DOUBLE) END AS mortality, CASE WHEN procedures > 0 AND income > 0 THEN cost / procedures / income END AS burden FROM full_panel LEFT JOIN fac USING (entity)),
q AS (SELECT """
    + ", ".join(f"quantile_cont({c}, 0.01) AS l_{c}, quantile_cont({c}, 0.99) AS h_{c}" for c in _FIVE)
    + " FROM v), z AS (SELECT entity, period, "
    + ", ".join(("1 - " if c in ("mortality", "burden") else "") + f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN h_{c} > l_{c} THEN (least(greatest({c}, l_{c}), h_{c}) - l_{c}) / (h_{c} - l_{c}) ELSE {c} END END AS {c}" for c in _FIVE)
    + " FROM v, q) SELECT entity, period, round(exp(list_avg(list_transform(list_filter(["
    + ", ".join(_FIVE)
    + "], lambda x: x IS NOT NULL), lambda x: ln(greatest(x, 0.001))))), 6) AS score FROM z"
)
def five_indicator_composite(spark, d):
    """Access, density, volume, mortality and burden in one score; the last two are better when low."""
    facilities = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("facilities"), F.count_if(F.col("s_acctbal") > 0).alias("open"))
    p, n, c, i = (F.col(x) for x in ("procedures", "population", "cost", "income"))
    rows = full(spark, d).join(facilities, "entity", "left").withColumns({"access": F.col("open") / F.col("facilities"), "density": X.rate(F.col("facilities"), n), "volume": I.volume(p, n), "mortality": I.mortality(F.col("deaths"), p, 80), "burden": I.financial_risk(c, p, i)})
    return I.winsorised_composite(rows, _FIVE, ["mortality", "burden"]).select("entity", "period", r("score").alias("score"))


@query(
    _PANEL
    + """SELECT entity, period, round(procedures / CAST(nullif(population, 0) AS DOUBLE) * 100000, 6) AS volume, round(CASE WHEN procedures >= 80 THEN deaths / CAST(procedures AS DOUBLE) END, 6) AS mortality,
  round(CASE WHEN procedures > 0 AND income > 0 THEN cost / procedures / income END, 6) AS financial_risk, CASE WHEN procedures > 0 AND income > 0 THEN CASE WHEN cost / procedures > 25.0 * income THEN 1.0 ELSE 0.0 END END AS catastrophic,
  CASE WHEN procedures / CAST(nullif(population, 0) AS DOUBLE) * 100000 >= 150000 THEN 1 ELSE 0 END AS meets_volume FROM full_panel"""
)
def rate_indicators(spark, d):
    p, n, c, i = (F.col(x) for x in ("procedures", "population", "cost", "income"))
    return full(spark, d).select("entity", "period", r(I.volume(p, n)).alias("volume"), r(I.mortality(F.col("deaths"), p, 80)).alias("mortality"), r(I.financial_risk(c, p, i)).alias("financial_risk"), I.catastrophic(c, p, i, 25.0).alias("catastrophic"), X.flag(I.volume(p, n) >= 150000).alias("meets_volume"))


@query(
    _PANEL
    + """, pros AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS entity, round(coalesce(n, 0) / CAST(nullif(population, 0) AS DOUBLE) * 100000, 6) AS density FROM nation LEFT JOIN people ON entity = n_nationkey LEFT JOIN pros USING (entity)"""
)
def workforce_density(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity"))
    pros = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").cast("long").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    rows = nation.join(people(spark, d), "entity", "left").join(pros, "entity", "left")
    return rows.select("entity", r(I.density(F.col("n"), F.col("population"))).alias("density"))


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN least(greatest(c_acctbal / 5000, 0), 1) END, 6) AS covered, round(CASE WHEN c_acctbal >= 0 THEN 1 - least(greatest(c_acctbal / 5000, 0), 1) END, 6) AS rest FROM customer""")
def coverage_clip(spark, d):
    covered, rest = N.coverage(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(5000))
    return table(spark, d, "customer").select("c_custkey", r(covered).alias("covered"), r(rest).alias("rest"))


_PLACES = "SELECT c_custkey AS place, CAST(c_custkey % 120 - 60 AS DOUBLE) AS lat, CAST((c_custkey * 7) % 360 - 180 AS DOUBLE) AS lon FROM customer"
_FACILITIES = "SELECT s_suppkey AS facility, CAST(s_suppkey * 15 AS BIGINT) AS f_place, CAST((s_suppkey * 13) % 140 - 70 AS DOUBLE) AS f_lat, CAST((s_suppkey * 31) % 360 - 180 AS DOUBLE) AS f_lon FROM supplier"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians(f_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(f_lat)) * power(sin(radians(f_lon - lon) / 2), 2))))"


def places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    where = table(spark, d, "customer").select(key.alias("place"), (key % 120 - 60).cast("double").alias("lat"), ((key * 7) % 360 - 180).cast("double").alias("lon"))
    s = F.col("s_suppkey")
    facilities = table(spark, d, "supplier").select(s.alias("facility"), (s * 15).alias("f_place"), ((s * 13) % 140 - 70).cast("double").alias("f_lat"), ((s * 31) % 360 - 180).cast("double").alias("f_lon"))
    return where, facilities


@query(
    f"""WITH p AS ({_PLACES}), f AS ({_FACILITIES}), k AS (SELECT place, facility, CASE WHEN place = f_place THEN 0.0 ELSE {_KM} END AS km FROM p, f)
SELECT place, round(min(km), 6) AS min_km, count(*) FILTER (WHERE km <= 500) AS within_500, count(*) FILTER (WHERE km <= 1000) AS within_1000, CASE WHEN min(km) <= 150 THEN 1 ELSE 0 END AS has_access FROM k GROUP BY place"""
)
def nearest_facility_haversine(spark, d):
    found = I.nearest_facility(*places(spark, d), radii=(500, 1000))
    return found.select("place", r("min_km").alias("min_km"), "within_500", "within_1000", X.flag(F.col("min_km") <= 150).alias("has_access"))


@query(
    f"""WITH p AS ({_PLACES}), f AS ({_FACILITIES}), k AS (SELECT place, CASE WHEN place = f_place THEN 0.0 ELSE {_KM} END AS km FROM p, f)
SELECT place, round(min(km), 6) AS min_km, count(*) FILTER (WHERE km <= 500) AS within_500 FROM k GROUP BY place"""
)
def nearest_facility_by_cells(spark, d):
    return I.by_cells(*places(spark, d), radii=(500,)).select("place", r("min_km").alias("min_km"), "within_500")


@query(f"""WITH RECURSIVE g AS (SELECT CAST(n_regionkey AS BIGINT) AS region, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT CASE WHEN grouping(region) = 1 THEN 'Overall' ELSE CAST(region AS VARCHAR) END AS "group", count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.75) AS q75 FROM g GROUP BY GROUPING SETS ((region), ())),
need AS (SELECT DISTINCT CAST(n - 1 AS DOUBLE) AS df, 0.975 AS q FROM s), {T_QUANTILES}
SELECT "group", n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, round(mean - t * sd / sqrt(n), 6) AS ci_low, round(mean + t * sd / sqrt(n), 6) AS ci_high, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75 FROM s JOIN tq ON df = n - 1""")
def descriptives_grouping_sets(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("region"))
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = A.with_t_interval(A.describe(rows, ["c_acctbal"], "region"))
    return out.select("group", "n", *(r(c).alias(c) for c in ("mean", "sd", "se", "ci_low", "ci_high", "median", "q25", "q75")))


@query("SELECT round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd, round(quantile_cont(o_totalprice, 0.5), 6) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS n FROM orders")
def describe(spark, d):
    return A.describe(table(spark, d, "orders"), ["o_totalprice"]).select(r("mean").alias("mean"), r("sd").alias("sd"), r("median").alias("median"), "min", "max", "n")


@query(
    _PANEL
    + """, a AS (SELECT *, procedures - avg(procedures) OVER (PARTITION BY entity) AS x1, cost - avg(cost) OVER (PARTITION BY entity) AS y1 FROM panel), b AS (SELECT *, x1 - avg(x1) OVER (PARTITION BY period) AS x, y1 - avg(y1) OVER (PARTITION BY period) AS y FROM a)
SELECT round(sum(x * y) / sum(x * x), 4) AS slope, count(*) AS n FROM b"""
)
def two_way_within_slope(spark, d):
    rows = N.demean_two_way(panel(spark, d).withColumn("x", F.col("procedures").cast("double")).withColumn("y", F.col("cost")), ["x", "y"], "entity", "period")
    return rows.agg(r(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 4).alias("slope"), F.count(F.lit(1)).alias("n"))


@query(
    _PANEL
    + """, b AS (SELECT entity, procedures - avg(procedures) OVER (PARTITION BY entity) AS x, cost - avg(cost) OVER (PARTITION BY entity) AS y FROM panel), s AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, count(*) AS n, count(DISTINCT entity) AS g FROM b),
u AS (SELECT entity, sum(x * (y - beta * x)) AS u FROM b, s GROUP BY entity)
SELECT 'procedures' AS term, round(any_value(beta), 3) AS coef, round(sqrt(sum(u * u)) / any_value(xx), 3) AS se, any_value(n) AS n FROM u, s"""
)
def cluster_robust_se(spark, d):
    fit = S.fixed_effects(panel(spark, d), "cost", ["procedures"], "entity", "period", two_way=False, small_sample=False)
    return S.result_frame(spark, {"entity effects": fit}).select("term", r("coef", 3).alias("coef"), r("se", 3).alias("se"), "n")


@query(
    _PANEL
    + """, x AS (SELECT CAST(procedures AS DOUBLE) AS x, cost / 100000 AS y FROM panel), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum((x - (SELECT avg(x) FROM x)) * (x - (SELECT avg(x) FROM x))) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM x),
e AS (SELECT x - mx AS dx, (y - my - sxy / sxx * (x - mx)) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx) AS e3, sxx, sxy, n FROM x, m)
SELECT round(any_value(sxy / sxx), 6) AS coef, round(sqrt(sum(dx * dx * e3 * e3)) / any_value(sxx), 6) AS se_hc3, any_value(n) AS n FROM e"""
)
def ols_hc3(spark, d):
    rows = panel(spark, d).select(F.col("procedures").cast("double").alias("x"), (F.col("cost") / 100000).alias("y"))
    return S.result_frame(spark, {"ols": S.ols_hc3(rows, "y", ["x"])}).filter("term = 'x'").select(r("coef").alias("coef"), r("se").alias("se_hc3"), "n")


@query(_PANEL + "SELECT round(regr_slope(cost, procedures), 4) AS slope, round(regr_r2(cost, procedures), 6) AS r2, count(*) AS n FROM panel")
def ols_simple(spark, d):
    return panel(spark, d).agg(r(F.regr_slope("cost", "procedures"), 4).alias("slope"), r(F.regr_r2("cost", "procedures")).alias("r2"), F.count(F.lit(1)).alias("n"))


@query(
    _PANEL
    + """, v AS (SELECT entity AS id, sum(cost) / sum(procedures) AS value FROM panel GROUP BY 1), z AS (SELECT id, value - (SELECT avg(value) FROM v) AS z FROM v), e AS (SELECT a.id AS src, b.id AS dst FROM z a JOIN z b ON abs(a.id - b.id) = 1),
w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM e)
SELECT (SELECT count(*) FROM z) AS n, round((SELECT count(*) FROM z) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS morans_i FROM w JOIN z a ON src = a.id JOIN z b ON dst = b.id"""
)
def morans_i(spark, d):
    values = panel(spark, d).groupBy(F.col("entity").alias("id")).agg((F.sum("cost") / F.sum("procedures")).alias("value"))
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    edges = ids.select("src", F.explode(F.array(F.col("src") - 1, F.col("src") + 1)).alias("dst"), F.lit(1.0).alias("w"))
    return S.morans_i(values, edges).select("n", r("morans_i").alias("morans_i"))


@query(
    _PANEL
    + """, f AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM f WHERE k = 1"""
)
def dedup_keep_first(spark, d):
    return P.keep_first(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def latest_wins(spark, d):
    rows = table(spark, d, "customer")
    return P.keep_latest(rows, ["c_nationkey"], "c_custkey").select("c_nationkey", "c_custkey")


_INDEX = "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, avg(o_totalprice) AS idx FROM orders GROUP BY 1, 2"


def price_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(year("o_orderdate").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.avg("o_totalprice").alias("index"))


@query(f"WITH i AS ({_INDEX}), b AS (SELECT idx AS base FROM i WHERE month = 12 AND year = 1995) SELECT year, round(base / idx, 6) AS factor FROM i LEFT JOIN b ON true WHERE month = 12")
def deflation_factors(spark, d):
    return P.deflation_factors(price_index(spark, d), 1995).select("year", r("factor").alias("factor"))


@query(_PANEL + f", i AS ({_INDEX}), b AS (SELECT idx AS base FROM i WHERE month = 12 AND year = 1995) SELECT entity, period, round(cost * base / idx, 2) AS cost, round(cost, 2) AS cost_nominal FROM panel LEFT JOIN i ON period = year AND month = 12 LEFT JOIN b ON true")
def deflated_panel(spark, d):
    factors = P.deflation_factors(price_index(spark, d), 1995).withColumnRenamed("year", "period")
    return P.deflate(panel(spark, d), ["cost"], factors, "period").select("entity", "period", r("cost", 2).alias("cost"), r("cost_nominal", 2).alias("cost_nominal"))


@query(
    _PANEL
    + """, y AS (SELECT DISTINCT period FROM ev), few AS (SELECT * FROM panel WHERE entity % 5 <> 0)
SELECT CAST(n_nationkey AS BIGINT) AS entity, y.period, procedures, population FROM nation CROSS JOIN y LEFT JOIN few f ON f.entity = n_nationkey AND f.period = y.period LEFT JOIN people p ON p.entity = n_nationkey"""
)
def scaffold_left_join(spark, d):
    entities = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entity"))
    periods = table(spark, d, "orders").select(year("o_orderdate").alias("period"))
    sources = [(P.SourceSpec("events", ["procedures"]), panel(spark, d).filter("entity % 5 <> 0")), (P.SourceSpec("people", ["population"], cross_sectional=True), people(spark, d))]
    return P.assemble(entities, periods, sources).select("entity", "period", "procedures", "population")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey >= 5 GROUP BY 1) SELECT k, customers, suppliers FROM a FULL JOIN b USING (k)""")
def full_outer(spark, d):
    a = table(spark, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").filter("s_nationkey >= 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return P.outer_chain([a, b], ["k"])


@query(
    _PANEL
    + """, m(original, canonical, valid_from) AS (VALUES (3, 103, 1994), (3, 203, 1996), (7, 107, 1900), (11, 111, 1997)), c AS (SELECT entity, period, max_by(canonical, valid_from) AS new FROM panel JOIN m ON original = entity AND valid_from <= period GROUP BY 1, 2)
SELECT CAST(coalesce(new, entity) AS BIGINT) AS entity, period, procedures FROM panel LEFT JOIN c USING (entity, period)"""
)
def temporal_code_lookup(spark, d):
    mapping = spark.createDataFrame([(3, 103, 1994), (3, 203, 1996), (7, 107, 1900), (11, 111, 1997)], "original long, canonical long, valid_from long")
    return P.crosswalk(panel(spark, d), "entity", "period", mapping).select("entity", "period", "procedures")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) * 100 + month(o_orderdate) = (SELECT max(year(o_orderdate) * 100 + month(o_orderdate)) FROM orders)")
def latest_snapshot(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return P.latest_period(rows, ["y", "m"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND month(o_orderdate) = (SELECT max(month(o_orderdate)) FROM orders)")
def latest_independent_maxima(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return P.latest_period(rows, ["y", "m"], independent=True).select("o_orderkey", "o_totalprice")


@query("""WITH old AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(new.c_custkey, old.c_custkey) AS c_custkey, round(coalesce(new.c_acctbal, old.c_acctbal), 6) AS c_acctbal FROM old FULL JOIN new USING (c_custkey)""")
def upsert_replace(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = P.upsert(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])
    return out.select("c_custkey", r("c_acctbal").alias("c_acctbal"))


@query("""WITH old AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.c_custkey, new.c_custkey) AS c_custkey, round(coalesce(old.c_acctbal, new.c_acctbal), 6) AS c_acctbal FROM old FULL JOIN new USING (c_custkey)""")
def upsert_ignore(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = P.upsert(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"], replace=False)
    return out.select("c_custkey", r("c_acctbal").alias("c_acctbal"))


@query("""WITH x AS (SELECT l_orderkey AS entity, l_linenumber AS period, l_partkey, l_suppkey, l_extendedprice FROM lineitem), v AS (SELECT *, CASE WHEN entity % 50 = 0 THEN 'invalid_entity' WHEN period NOT BETWEEN 1 AND 6 THEN 'bad_period' END AS reason FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY entity, period, reason IS NULL ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM v) SELECT coalesce(CASE WHEN reason IS NULL AND n > 1 THEN 'duplicate_key' ELSE reason END, 'clean') AS status, count(*) AS n FROM k GROUP BY 1""")
def quarantine_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("period"), "l_partkey", "l_suppkey", "l_extendedprice")
    valid = rows.select("entity").filter("entity % 50 <> 0").distinct()
    return Q.quarantine_counts(rows, valid, "entity", "period", 1, 6, ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return P.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT CAST(n_regionkey AS BIGINT) AS region, round(sum(c_acctbal * w) / sum(w), 6) AS c_acctbal, count(*) AS n_people, count(DISTINCT c_nationkey) AS n_entities FROM (SELECT c_nationkey, n_regionkey, c_acctbal, CASE WHEN c_acctbal IS NOT NULL THEN 1.0 + c_custkey % 7 END AS w FROM (SELECT c_custkey, c_nationkey, n_regionkey, CASE WHEN c_acctbal > -500 THEN c_acctbal END AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)) GROUP BY 1""")
def weighted_mean_region(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("region"))
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("region", "c_nationkey", F.when(F.col("c_acctbal") > -500, F.col("c_acctbal")).alias("c_acctbal"), (F.lit(1.0) + F.col("c_custkey") % 7).alias("w"), F.lit(1).cast("long").alias("n_people"))
    return A.weighted_means(rows, "region", "w", ["c_acctbal"], ["n_people"], "c_nationkey").select("region", r("c_acctbal").alias("c_acctbal"), "n_people", "n_entities")


_STD = """WITH b AS (SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(c_custkey % 17 AS INTEGER) AS band, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
pop AS (SELECT region, band, count(*) AS population FROM b GROUP BY 1, 2), ev AS (SELECT region, band, count(*) AS n FROM orders JOIN b ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT band, sum(population) / CAST((SELECT sum(population) FROM pop) AS DOUBLE) AS weight FROM pop GROUP BY 1)
SELECT region, round(sum(coalesce(n, 0) / CAST(population AS DOUBLE) * 100000 * weight), 4) AS standardised_rate, round(sum(coalesce(n, 0)) / CAST(sum(population) AS DOUBLE) * 100000, 4) AS crude_rate FROM pop LEFT JOIN ev USING (region, band) JOIN w USING (band) GROUP BY region"""


@query(_STD)
def direct_standardised_rate(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("region"))
    bands = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("region", (F.col("c_custkey") % 17).cast("int").alias("band"), "c_custkey")
    population = bands.groupBy("region", "band").agg(F.count(F.lit(1)).alias("population"))
    counts = table(spark, d, "orders").join(bands, F.col("o_custkey") == F.col("c_custkey")).groupBy("region", "band").agg(F.count(F.lit(1)).alias("n"))
    return A.standardised_rates(counts, population, ["region"], "band").select("region", r("standardised_rate", 4).alias("standardised_rate"), r("crude_rate", 4).alias("crude_rate"))


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Line items with values made missing by rule."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(year("l_shipdate").alias("period"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.08)).alias("tax"), "l_quantity")


_GAPS = "WITH g AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS period, nullif(l_discount, 0.0) AS discount, nullif(l_tax, 0.08) AS tax, l_quantity FROM lineitem)"
_PCT = "round_even(100.0 * CAST(count(*) - count({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE), 2)"


@query(_PANEL + "SELECT entity, period, round(period - avg(period) OVER (), 6) AS trend, round(CASE WHEN population > 0 THEN ln(population) END, 6) AS log_population, round(ln(1 + deaths), 6) AS log_deaths, round(cost * 1000 / CAST(nullif(population, 0) AS DOUBLE), 4) AS per_head FROM full_panel")
def model_inputs(spark, d):
    """A centred trend, logarithms, and cost per head as models take them."""
    rows = N.centred(full(spark, d), "period", "trend")
    logs = {"log_population": X.ln_positive(F.col("population")), "log_deaths": X.log1p_floored(F.col("deaths"))}
    return rows.select("entity", "period", r("trend").alias("trend"), *(r(c).alias(n) for n, c in logs.items()), r(X.per_head(F.col("cost"), F.col("population")), 4).alias("per_head"))


@query("""WITH c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2),
g AS (SELECT year, month, 100 * (p / lag(p) OVER (ORDER BY year, month) - 1) AS change FROM c)
SELECT year, month, round(100 * exp(sum(ln(1 + coalesce(change, 0) / 100)) OVER (ORDER BY year, month)), 5) AS "index" FROM g""")
def chained_price_index(spark, d):
    means = price_index(spark, d)
    before = F.lag("index").over(W.partitionBy(F.lit(1)).orderBy("year", "month"))  # a row a month
    changes = means.select("year", "month", (F.lit(100.0) * (F.col("index") / before - 1)).alias("change"))
    return P.chain_index(changes, ["year", "month"], "change").select("year", "month", r("index", 5).alias("index"))


@query("SELECT CAST(year(ts) AS BIGINT) AS year, round(avg(value / 4.0), 6) AS mean_rate, round(max(value / 4.0) FILTER (WHERE ts = last), 6) AS last_rate FROM (SELECT *, max(ts) OVER (PARTITION BY year(ts)) AS last FROM events WHERE value IS NOT NULL) GROUP BY 1")
def annual_exchange_rates(spark, d):
    return P.annual_rates(table(spark, d, "events"), "ts", "value", 4.0).select("year", r("mean_rate").alias("mean_rate"), r("last_rate").alias("last_rate"))


@query("SELECT n_nationkey, r_comment FROM nation LEFT JOIN (SELECT n_name, n_regionkey, 'x' || CAST(n_nationkey AS VARCHAR) AS r_comment FROM nation WHERE n_nationkey % 4 <> 0) r USING (n_name, n_regionkey)")
def composite_name_join(spark, d):
    """Names in another spelling, with their region, meet their nation."""
    nation = table(spark, d, "nation")
    other = nation.filter("n_nationkey % 4 <> 0").select(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("name"), F.col("n_regionkey").alias("part"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("r_comment"))
    return P.join_by_name(nation, other, "n_name", "n_regionkey", "name", "part").select("n_nationkey", "r_comment")


@query(_GAPS + f""" SELECT 'period' AS "column", 'bigint' AS type, 'bigint' AS documented, 'ok' AS status, {_PCT.format(c="period")} AS pct_missing FROM g UNION ALL SELECT 'discount', 'double', 'double', 'ok', {_PCT.format(c="discount")} FROM g
UNION ALL SELECT 'tax', 'double', 'string', 'type', {_PCT.format(c="tax")} FROM g UNION ALL SELECT 'l_quantity', 'double', NULL, 'undocumented', {_PCT.format(c="l_quantity")} FROM g UNION ALL SELECT 'rebate', NULL, 'double', 'absent', NULL""")
def dictionary_check(spark, d):
    return Q.check_dictionary(with_gaps(spark, d), {"period": "bigint", "discount": "double", "tax": "string", "rebate": "double"})


_MECHANISMS = {"discount": ("MNAR", "multiple_imputation"), "tax": ("MAR", "left_as_missing"), "l_quantity": ("NA", "none"), "rebate": ("source_unavailable", "documented_gap"), "fixed_price": ("cross_sectional", "constant_fill")}


@query(
    _GAPS.replace(", l_quantity FROM", ", l_quantity, CAST(NULL AS DOUBLE) AS rebate, CASE WHEN l_linenumber = 1 THEN l_extendedprice END AS fixed_price FROM")
    + " UNION ALL ".join(f" SELECT '{c}' AS variable, period, count(*) AS n_total, count({c}) AS n_observed, count(*) - count({c}) AS n_missing, {_PCT.format(c=c)} AS pct_missing, '{m}' AS mechanism, '{h}' AS handling FROM g GROUP BY period" for c, (m, h) in _MECHANISMS.items())
)
def missingness_mechanisms(spark, d):
    """Missing cells of each variable and year, why they are missing, and what is done about them."""
    l = table(spark, d, "lineitem")  # noqa: E741
    rows = l.select(year("l_shipdate").alias("period"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.08)).alias("tax"), "l_quantity", F.lit(None).cast("double").alias("rebate"), F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice")).alias("fixed_price"))
    handling = {"MNAR": "multiple_imputation", "cross_sectional": "constant_fill", "source_unavailable": "documented_gap", "NA": "none"}
    return A.with_mechanism(A.missingness(rows, list(_MECHANISMS), "period"), {"discount": "MNAR", "fixed_": "cross_sectional"}, ["rebate", "tax"], handling)


@query(
    _GAPS
    + " UNION ALL ".join(f" SELECT '{c}' AS variable, period, count(*) AS n_total, count({c}) AS n_observed, count(*) - count({c}) AS n_missing, {_PCT.format(c=c)} AS pct_missing, CASE WHEN count(*) = count({c}) THEN 'complete' ELSE '{h}' END AS handling FROM g GROUP BY period" for c, h in (("discount", "chained equations"), ("tax", "none"), ("l_quantity", "none")))
)
def missingness_long(spark, d):
    return A.missingness(with_gaps(spark, d), ["discount", "tax", "l_quantity"], "period", {"discount": "chained equations"})


@query(
    _GAPS
    + " UNION ALL ".join(f" SELECT '{c}' AS variable, " + ", ".join(f"round_even(100.0 * CAST(count(*) FILTER (WHERE {c} IS NULL AND period = {y}) AS DOUBLE) / CAST(count(*) FILTER (WHERE period = {y}) AS DOUBLE), 2) AS y{y}" for y in _SHIP_YEARS) + f", {_PCT.format(c=c)} AS overall FROM g" for c in ("discount", "tax"))
)
def missingness_wide(spark, d):
    rows = with_gaps(spark, d)
    years = A.periods(rows, "period")
    wide = A.missingness_wide(rows, ["discount", "tax"], "period", years)
    return wide.select("variable", *(F.col(str(y)).alias(f"y{y}") for y in years), "overall")


@query(_GAPS + " UNION ALL ".join(f" SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, {_PCT.format(c=c)} AS pct_missing FROM g" for c in ("period", "discount", "tax", "l_quantity")))
def data_dictionary(spark, d):
    return Q.data_dictionary(with_gaps(spark, d)).select("column", "n_missing", "pct_missing")


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT CAST((o_totalprice > q1)::INT + (o_totalprice > q2)::INT + (o_totalprice > q3)::INT AS INTEGER) AS bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM orders, e GROUP BY 1""")
def quantile_bins(spark, d):
    return A.quantile_group_means(table(spark, d, "orders"), "o_totalprice", 4, ["o_totalprice"]).select("bin", "n", r("mean_o_totalprice", 4).alias("mean_o_totalprice"))


@query("""WITH e AS (SELECT quantile_cont(l_quantity, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM lineitem), b AS (SELECT greatest(len(list_filter(list_distinct(q), lambda x: x < l_quantity)) - 1, 0) AS bin, l_quantity AS x, l_extendedprice AS y FROM lineitem, e)
SELECT CAST(bin AS INTEGER) AS bin, round(avg(x), 6) AS mean_x, round(avg(y), 4) AS mean_y, count(*) AS n, round(stddev_samp(y) / sqrt(count(*)), 4) AS sem FROM b GROUP BY bin""")
def dose_response_bins(spark, d):
    out = A.dose_response(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10)
    return out.select("bin", r("mean_x").alias("mean_x"), r("mean_y", 4).alias("mean_y"), "n", r("sem", 4).alias("sem"))


@query("SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'discount', round(corr(l_quantity, nullif(l_discount, 0.0)), 6), count(nullif(l_discount, 0.0)) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'discount', round(corr(l_extendedprice, nullif(l_discount, 0.0)), 6), count(nullif(l_discount, 0.0)) FROM lineitem")
def pearson_pairwise(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("discount"))
    return A.correlations(rows, ["l_quantity", "l_extendedprice", "discount"]).select("x", "y", r("r").alias("r"), "n")


@query("""WITH a AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM a""")
def spearman_rank(spark, d):
    return A.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r("rho").alias("rho"), "n")


@query(
    _PANEL
    + """, s AS (SELECT entity, CAST(sum(deaths) AS DOUBLE) AS k, CAST(sum(procedures) AS DOUBLE) AS n FROM panel GROUP BY 1), z AS (SELECT *, k / n AS p, 1.959963984540054 * 1.959963984540054 AS zz FROM s)
SELECT entity, round(greatest((p + zz / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 0), 6) AS low, round(least((p + zz / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 1), 6) AS high FROM z"""
)
def wilson_interval(spark, d):
    rows = panel(spark, d).groupBy("entity").agg(F.sum("deaths").alias("k"), F.sum("procedures").alias("n"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return rows.select("entity", r(low).alias("low"), r(high).alias("high"))


_FLOW = "WITH f AS (SELECT c_nationkey AS origin, s_nationkey AS destination, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def shipments(spark: SparkSession, d: str) -> DataFrame:
    """origin and destination nation of every line item."""
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("origin"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("destination"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("origin", "destination", "l_extendedprice")


@query(_FLOW + " SELECT origin, destination, count(*) AS flow FROM f WHERE origin <> destination GROUP BY 1, 2 ORDER BY flow DESC, origin, destination LIMIT 50")
def flows_topk(spark, d):
    return A.top_flows(A.flows(shipments(spark, d), "origin", "destination"))


@query(_FLOW + " SELECT origin, count(*) AS n, count(*) FILTER (WHERE origin = destination) AS n_self, round(100.0 * count(*) FILTER (WHERE origin = destination) / count(*), 6) AS pct_self, round(avg(abs(origin - destination) * 100.0) FILTER (WHERE origin <> destination), 6) AS mean_km, round(quantile_cont(CASE WHEN origin <> destination THEN abs(origin - destination) * 100.0 END, 0.5), 6) AS median_km, round(quantile_cont(CASE WHEN origin <> destination THEN abs(origin - destination) * 100.0 END, 0.9), 6) AS p90_km, CAST(max(abs(origin - destination) * 100.0) FILTER (WHERE origin <> destination) AS DOUBLE) AS max_km FROM f GROUP BY 1")
def distance_summary(spark, d):
    rows = shipments(spark, d).withColumn("km", F.abs(F.col("origin") - F.col("destination")) * F.lit(100.0))
    out = A.distance_summary(rows, "origin", "km", F.col("origin") == F.col("destination"))
    return out.select("origin", "n", "n_self", *(r(c).alias(c) for c in ("pct_self", "mean_km", "median_km", "p90_km")), "max_km")


@query("SELECT c_nationkey, CAST(year(o_orderdate) AS BIGINT) AS period, count(*) AS n_events, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_deaths, round(sum(o_totalprice), 2) AS total_value, round(avg(o_totalprice % 30), 4) AS mean_stay FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def event_rollup(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumns({"period": year("o_orderdate"), "stay": F.col("o_totalprice") % 30})
    out = A.event_rollup(rows, ["c_nationkey", "period"], "o_orderkey", F.col("o_orderstatus") == "F", "o_totalprice", "stay")
    return out.select("c_nationkey", "period", "n_events", "n_deaths", r("total_value", 2).alias("total_value"), r("mean_stay", 4).alias("mean_stay"))


@query("SELECT o_orderpriority, count(*) AS n_events, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_deaths, round_even(100.0 * CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / CAST(count(*) AS DOUBLE), 3) AS mortality_pct FROM orders GROUP BY 1")
def pct_round_half_even(spark, d):
    return A.mortality_rollup(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("SELECT c_nationkey, count(*) AS n_total, count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS n_surgery, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS n_anaesthesia FROM customer GROUP BY 1")
def conditional_counts(spark, d):
    return A.category_counts(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", {"surgery": ["BUILDING", "MACHINERY"], "anaesthesia": ["HOUSEHOLD"]})


@query("WITH q AS (SELECT c_nationkey, CAST(year(o_orderdate) AS BIGINT) AS period, quarter(o_orderdate) AS q, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) SELECT c_nationkey, period, round(avg(n), 6) AS n FROM q GROUP BY 1, 2")
def quarterly_mean(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    quarters = rows.groupBy("c_nationkey", year("o_orderdate").alias("period"), F.quarter("o_orderdate").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return A.period_rollup(quarters, ["c_nationkey", "period"], [], ["n"]).select("c_nationkey", "period", r("n").alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_event_rollup(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


@query("WITH g AS (SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS y, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT r_name, " + ", ".join(f"round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE y = {y}), 4) AS y{y}" for y in _ORDER_YEARS) + " FROM g GROUP BY 1")
def region_year_median_pivot(spark, d):
    regions = regional(spark, d)
    years = A.periods(regions, "period")
    out = A.medians_by(regions, "r_name", "period", years, "o_totalprice")
    return out.select("r_name", *(r(F.col(str(y)), 4).alias(f"y{y}") for y in years))


def regional(spark: SparkSession, d: str) -> DataFrame:
    """Orders with region name and period."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customer = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "c_acctbal")
    return table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("period", year("o_orderdate"))


@query("WITH g AS (SELECT r_name, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)" + " UNION ALL ".join(f" SELECT r_name AS \"group\", '{c}' AS variable, count({c}) AS n, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM g GROUP BY 1" for c in ("o_totalprice", "c_acctbal")))
def disparity_long(spark, d):
    out = A.describe(regional(spark, d), ["o_totalprice", "c_acctbal"], "r_name").filter("group <> 'Overall'")
    return out.select("group", "variable", "n", r("mean", 4).alias("mean"), r("median", 4).alias("median"), r(F.col("q75") - F.col("q25"), 4).alias("iqr"))


@query("WITH g AS (SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS period, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT r_name, period, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se FROM g GROUP BY 1, 2")
def temporal_trend(spark, d):
    rows = regional(spark, d).groupBy("r_name", "period").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"))
    return A.with_t_interval(rows).select("r_name", "period", "n", r("mean", 4).alias("mean"), r("se", 4).alias("se"))


@query(_PANEL + "SELECT period, round(avg(deaths), 6) AS mean_deaths, round(sum(cost), 2) AS sum_cost, count(DISTINCT entity) AS n_entity, round(quantile_cont(cost, 0.5), 4) AS median_cost, quantile_cont(CAST(procedures AS DOUBLE), 0.5) AS median_procedures FROM panel GROUP BY 1")
def yearly_trends(spark, d):
    out = A.trends(panel(spark, d), "period", ["deaths"], ["cost", "procedures"], ["cost"], ["entity"])
    return out.select("period", r("mean_deaths").alias("mean_deaths"), r("sum_cost", 2).alias("sum_cost"), "n_entity", r("median_cost", 4).alias("median_cost"), "median_procedures")


@query("WITH g AS (SELECT r_name, o_totalprice, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT CASE WHEN grouping(r_name) = 1 THEN 'Overall' ELSE r_name END AS \"group\", count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd FROM g GROUP BY GROUPING SETS ((r_name), ())")
def regional_summary(spark, d):
    return A.describe(regional(spark, d), ["o_totalprice"], "r_name").select("group", "n", r("mean", 4).alias("mean"), r("median", 4).alias("median"), r("sd", 4).alias("sd"))


@query("SELECT c_custkey, c_acctbal FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    large = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_semi").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_acctbal FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, d):
    large = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_anti").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, upper(substr(p_brand, 1, 7)) IN ('BRAND#1', 'BRAND#3') AS in_class, coalesce(regexp_extract(p_type, '([A-Za-z]+)$', 1), '') AS material FROM part")
def prefix_class(spark, d):
    return table(spark, d, "part").select("p_partkey", X.prefix_in(F.col("p_brand"), ["BRAND#1", "BRAND#3"], 7).alias("in_class"), F.regexp_extract("p_type", "([A-Za-z]+)$", 1).alias("material"))


@query("SELECT CAST(least(floor(p_size / 5.0), 8) AS INTEGER) AS band, CASE WHEN p_size >= 40 THEN '40+' ELSE CAST(CAST(floor(p_size / 5.0) * 5 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(floor(p_size / 5.0) * 5 + 4 AS INTEGER) AS VARCHAR) END AS label, count(*) AS n FROM part GROUP BY 1, 2")
def bands(spark, d):
    return table(spark, d, "part").groupBy(X.band(F.col("p_size"), 5, 8).alias("band"), X.band_label(F.col("p_size"), 5, 8).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 7 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code, upper(trim(c_name)) || '_' || c_mktsegment AS name_key FROM customer")
def normalise_code(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.normalize_code(F.col("c_custkey")).alias("code"), X.name_key(F.col("c_name"), F.col("c_mktsegment")).alias("name_key"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN CAST(c_custkey % 90 AS INTEGER) WHEN c_custkey % 5 = 3 THEN CAST(floor((c_custkey % 90) / 12.0) AS INTEGER) WHEN c_custkey % 5 IN (1, 2) THEN 0 END AS age, CASE c_custkey % 4 WHEN 1 THEN 'M' WHEN 3 THEN 'F' END AS sex FROM customer")
def age_and_sex(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.when(key % 5 > 0, X.age_years((key % 90).cast("string"), (key % 5).cast("string"))).alias("age"), X.recode(key % 4, {"1": "M", "3": "F"}).alias("sex"))


@query("SELECT s_suppkey, s_suppkey % 4 = 1 OR s_suppkey % 6 = 1 OR s_suppkey % 7 + s_suppkey % 8 >= 10 AS any_of, s_suppkey % 4 = 1 AND s_suppkey % 6 = 1 AND s_suppkey % 7 + s_suppkey % 8 >= 10 AS all_of, CASE WHEN s_nationkey IN (1, 2) THEN 'surgeon' WHEN s_nationkey IN (3, 4) THEN 'anaesthetist' ELSE 'unknown' END AS kind FROM supplier")
def capability_flags(spark, d):
    key = F.col("s_suppkey")
    flags, counts = [(key % 4 == 1).cast("int"), (key % 6 == 1).cast("int")], [key % 7, key % 8]
    return table(spark, d, "supplier").select("s_suppkey", X.has_capability(flags, counts).alias("any_of"), X.has_capability(flags, counts, every=True).alias("all_of"), X.categorise(F.col("s_nationkey").cast("string"), {"surgeon": ["1", "2"], "anaesthetist": ["3", "4"]}).alias("kind"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_property_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("(SELECT c_nationkey AS k, 'documented' AS side FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey, 'documented' FROM supplier WHERE s_nationkey > 5) UNION ALL (SELECT s_nationkey, 'found' FROM supplier WHERE s_nationkey > 5 EXCEPT SELECT c_nationkey, 'found' FROM customer WHERE c_nationkey < 15)")
def set_ops(spark, d):
    a = table(spark, d, "customer").filter("c_nationkey < 15").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").filter("s_nationkey > 5").select(F.col("s_nationkey").alias("k"))
    return P.dictionary_differences(a, b)


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_keys(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("SELECT 'customer' AS kind, CAST(c_custkey AS BIGINT) AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS BIGINT), s_acctbal, NULL FROM supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("long").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("long").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_entities(spark, d):
    return A.top_entities(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def share_within_group(spark, d):
    out = N.share_within(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_extendedprice", ["l_orderkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("share").alias("share"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def zscore_within(spark, d):
    return N.zscore(table(spark, d, "customer"), "c_acctbal", ["c_nationkey"]).select("c_custkey", r("z").alias("z"))


@query(
    _PANEL
    + """, t AS (SELECT quantile_cont(procedures, 1.0 / 3) AS p1, quantile_cont(procedures, 2.0 / 3) AS p2, quantile_cont(cost, 1.0 / 3) AS c1, quantile_cont(cost, 2.0 / 3) AS c2 FROM panel)
SELECT entity, period, CAST(3 * ((cost > c1)::INT + (cost > c2)::INT) + (procedures > p1)::INT + (procedures > p2)::INT AS INTEGER) AS bivariate FROM panel, t"""
)
def bivariate_terciles(spark, d):
    return N.bivariate_classes(panel(spark, d), "procedures", "cost").select("entity", "period", "bivariate")


@query(
    _PANEL
    + """, a AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1), s AS (SELECT s_nationkey, count(*) AS n_suppliers, avg(s_acctbal) AS supplier_balance FROM supplier GROUP BY 1)
SELECT c_custkey, c_mktsegment, n_name, r_name, n_orders, round(spent, 2) AS spent, n_suppliers, round(supplier_balance, 4) AS supplier_balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN a ON o_custkey = c_custkey LEFT JOIN s ON s_nationkey = c_nationkey"""
)
def left_join_spine(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"), F.avg("s_acctbal").alias("supplier_balance"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    out = table(spark, d, "customer").join(places, "c_nationkey", "left").join(orders, "c_custkey", "left").join(suppliers, "c_nationkey", "left")
    return out.select("c_custkey", "c_mktsegment", "n_name", "r_name", "n_orders", r("spent", 2).alias("spent"), "n_suppliers", r("supplier_balance", 4).alias("supplier_balance"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS task, count(*) AS n FROM orders GROUP BY 1, 2")
def status_rollup(spark, d):
    return Q.status_rollup(table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("status")))


@query("WITH l AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM l WHERE s = 'F')")
def pending_tasks(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("ERROR").alias("status"), F.col("o_orderkey").alias("at"))
    return Q.pending_tasks(table(spark, d, "customer").select("c_custkey"), log, ["c_custkey"])


@query("SELECT CAST(year(m) AS BIGINT) AS y, CAST(month(m) AS BIGINT) AS mo FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)")
def month_sequence(spark, d):
    """Every month from the first order's to the last one's, with orders or without."""
    ends = table(spark, d, "orders").agg(*(F.trunc(f("o_orderdate"), "month").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))))
    months = ends.filter("first IS NOT NULL").select(F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("m"))
    return months.select(year("m").alias("y"), F.month("m").cast("long").alias("mo"))


@query("WITH g AS (SELECT DISTINCT n_regionkey FROM nation), f AS (SELECT n_regionkey, CAST((row_number() OVER (ORDER BY n_regionkey) - 1) % 3 AS INTEGER) AS fold FROM g) SELECT n_nationkey, fold FROM nation JOIN f USING (n_regionkey)")
def group_folds(spark, d):
    from ..operators import models

    return models.group_folds(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", 3).select("n_nationkey", "fold")


@query("SELECT c_mktsegment, count(*) AS n, round(covar_samp(c_nationkey, c_acctbal) / var_samp(c_nationkey), 6) AS slope FROM customer GROUP BY 1")
def effects_by_group(spark, d):
    from ..operators import models

    return models.effects_by_group(table(spark, d, "customer").withColumn("x", F.col("c_nationkey").cast("double")), "c_acctbal", "x", "c_mktsegment").select("c_mktsegment", "n", r("slope").alias("slope"))


