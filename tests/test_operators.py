import math
import random
from functools import partial

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.functions import exprs as X
from panelspark.operators import aggregate as A
from panelspark.operators import imputation
from panelspark.operators import indicators as I
from panelspark.operators import models as M
from panelspark.operators import normalize as N
from panelspark.operators import panel as P
from panelspark.operators import quality as Q
from panelspark.operators import stats as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_minmax_constant_group_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0), ("c", 1, None), ("a", 2, 5.0), ("b", 2, 5.0)], "e string, p int, x double")
    got = rows(N.minmax_within(df, ["x"], ["p"]).select("p", "e", "x"), "p", "e")
    assert got == [(1, "a", 0.0), (1, "b", 1.0), (1, "c", None), (2, "a", 0.5), (2, "b", 0.5)]
    turned = rows(N.minmax_within(df, ["x"], ["p"], inverted=["x"]).filter("p = 1").select("e", "x"))
    assert turned == [("a", 1.0), ("b", 0.0), ("c", None)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-1e6, 1e6)), min_size=1, max_size=30))
def test_minmax_stays_in_bounds(spark, data):
    out = N.minmax_within(spark.createDataFrame(data, "p int, x double"), ["x"], ["p"]).select("x").collect()
    assert len(out) == len(data) and all(0 <= r["x"] <= 1 for r in out)


def test_quantile_bins_drop_repeated_edges(spark):
    values = [0, 0, 0, 0, 1, 1, 2, 2]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = [r["bin"] for r in N.quantile_bins(df, "x", 4).orderBy("i").collect()]
    edges = np.unique(np.percentile(values, [0, 25, 50, 75, 100]))
    want = [max(int((edges < v).sum()) - 1, 0) for v in values]
    assert got == want


def test_bivariate_classes_of_values_that_differ_when_made_again(spark):
    """As sums of doubles do in their last digits: 31 values, two of which are tercile points themselves."""
    drawn = F.udf(lambda i: random.random(), "double").asNondeterministic()
    df = spark.range(31).withColumns({"x": drawn("id"), "y": drawn("id")})
    got = N.bivariate_classes(df, "x", "y").collect()
    place = {c: {r["id"]: i for i, r in enumerate(sorted(got, key=lambda r: r[c]))} for c in ("x", "y")}
    tercile = lambda i: (i > 10) + (i > 20)
    assert [r["bivariate"] for r in got] == [3 * tercile(place["y"][r["id"]]) + tercile(place["x"][r["id"]]) for r in got]


@pytest.mark.parametrize("counts", [[3], [1, 2], [1, 1, 1, 2], [1, 2, 2, 2], [1, 1, 2, 2, 2, 2, 3], [1, 1, 1, 1, 2, 3, 3]])
def test_bivariate_query_counts_equal_points_as_its_sql_does(spark, tmp_path, counts):
    """Orders of each nation in one year, at a price of 1."""
    from panelspark.plans import catalogue

    customers = [(k, k) for k in range(len(counts))]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, k, "F", 1.0, "1-URGENT") for k, n in enumerate(counts) for _ in range(n)]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.withColumn("o_orderdate", F.lit("1996-05-01").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["bivariate_terciles"](spark, str(tmp_path)).orderBy("entity").collect()
    a, b = np.quantile(counts, [1 / 3, 2 / 3])
    assert [r["bivariate"] for r in got] == [4 * (int(n > a) + int(n > b)) for n in counts]


def test_scaffold_and_sources(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "entity string")
    periods = spark.createDataFrame([(1,), (2,)], "period int")
    events = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 4.0)], "entity string, period int, V double")
    fixed = spark.createDataFrame([("b", 9.0)], "entity string, w double")
    got = rows(P.assemble(entities, periods, [(P.SourceSpec("e", ["v"], aliases={"v": ["V"]}), events), (P.SourceSpec("f", ["w", "missing"], cross_sectional=True), fixed)]))
    assert [g[:4] for g in got] == [("a", 1, 4.0, None), ("a", 2, None, None), ("b", 1, None, 9.0), ("b", 2, None, 9.0)]


def test_crosswalk_takes_the_latest_valid_row(spark):
    df = spark.createDataFrame([("x", 1), ("x", 5), ("y", 5)], "code string, period int")
    mapping = spark.createDataFrame([("x", "n1", 2), ("x", "n2", 4)], "original string, canonical string, valid_from int")
    assert rows(P.crosswalk(df, "code", "period", mapping).select("code", "period")) == [("n2", 5), ("x", 1), ("y", 5)]


def test_deflate(spark):
    index = spark.createDataFrame([(2000, 12, 100.0), (2001, 12, 200.0), (2001, 11, 1.0)], "year int, month int, index double")
    factors = P.deflation_factors(index, 2001)
    df = spark.createDataFrame([("a", 2000, 10.0), ("a", 2002, 10.0)], "e string, year int, cost double")
    assert rows(P.deflate(df, ["cost", "none"], factors, "year").select("year", "cost", "cost_nominal")) == [(2000, 20.0, 10.0), (2002, None, 10.0)]


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "o"), (2, "o")], [(2, "n"), (3, "n")]))
    assert rows(P.upsert(old, new, ["k"])) == [(1, "o"), (2, "n"), (3, "n")]
    assert rows(P.upsert(old, new, ["k"], replace=False)) == [(1, "o"), (2, "o"), (3, "n")]


def validation_frame(spark):
    return spark.createDataFrame([("a", 2015, 1), ("a", 2015, 2), ("z", 2015, 3), (None, 2015, 4), ("a", 2000, 5), ("b", None, 6), ("b", 2016, 7)], "e string, y int, v int"), spark.createDataFrame([("a",), ("b",)], "e string")


def test_validation_splits_rows(spark):
    df, valid = validation_frame(spark)
    clean, bad, report = Q.validate(df, valid, "e", "y", 2015, 2023)
    assert rows(clean) == [("a", 2015, 1), ("b", 2016, 7)]
    assert report.failures == {"invalid_entity": 2, "bad_period": 2, "duplicate_key": 1} and not report.passed and '"passed": false' in report.to_json()
    assert bad.count() + clean.count() == df.count()
    again, none, second = Q.validate(clean, valid, "e", "y", 2015, 2023)
    assert second.passed and none.count() == 0 and rows(again) == rows(clean)


def test_strict_validation_raises(spark):
    df, valid = validation_frame(spark)
    with pytest.raises(Q.ValidationError, match="invalid_entity"):
        Q.validate(df, valid, "e", "y", 2015, 2023, strict=True)
    with pytest.raises(Q.ValidationError, match="missing columns"):
        Q.validate(df, valid, "e", "y", 2015, 2023, required=["nope"])


def test_guards(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.0)], "e string, p int, x double")
    Q.require_rows(df, "p", 2)
    Q.require_normalised(df, ["x"], "p")
    with pytest.raises(Q.ValidationError):
        Q.require_rows(df, "p", 3)
    with pytest.raises(Q.ValidationError):
        Q.require_values(df.select("e", "p", F.lit(None).cast("double").alias("x")), ["e", "p"])


def test_weighted_mean_and_parity(spark):
    df = spark.createDataFrame([("r", 1.0, 10.0), ("r", None, 30.0), ("r", 3.0, 10.0), (None, 1.0, 1.0)], "g string, x double, w double")
    assert A.weighted_means(df, "g", "w", ["x"]).first()["x"] == pytest.approx(2.0)
    assert A.weighted_means(df, "g", "w", ["x"], parity=True).first()["x"] == pytest.approx(40 / 50)


def test_standardised_rate_by_hand(spark):
    pop = spark.createDataFrame([("a", 0, 100), ("a", 1, 100), ("b", 0, 300), ("b", 1, 100)], "k string, s int, population long")
    ev = spark.createDataFrame([("a", 0, 10), ("b", 0, 30), ("b", 1, 20)], "k string, s int, n long")
    got = {r["k"]: (r["standardised_rate"], r["crude_rate"]) for r in A.standardised_rates(ev, pop, ["k"], "s", per=1.0).collect()}
    assert got["a"] == pytest.approx((0.1 * 2 / 3, 0.05)) and got["b"] == pytest.approx((0.1 * 2 / 3 + 0.2 / 3, 0.125))
    parity = {r["k"]: r["crude_rate"] for r in A.standardised_rates(ev, pop, ["k"], "s", per=1.0, parity=True).collect()}
    assert parity["a"] == pytest.approx(0.1)


def test_rank_correlation_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 9.0), (None, 1.0)], "x double, y double")
    x, y = [1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4]
    assert A.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_t_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("a", 5.0), ("b", 1.0)], "g string, x double")
    got = {r["group"]: r for r in A.with_t_interval(A.describe(df, ["x"], "g")).collect()}
    assert got["a"]["ci_low"] == pytest.approx(3 - 2.776445 * got["a"]["se"], abs=1e-6) and got["b"]["ci_low"] is None and got["Overall"]["n"] == 6


def test_indicator_suppression(spark):
    df = spark.createDataFrame([(1, 9), (1, 10), (0, 0)], "d int, n int")
    assert [r["m"] for r in df.select(I.mortality(F.col("d"), F.col("n")).alias("m")).collect()] == [None, 0.1, None]
    cost = spark.createDataFrame([(1000.0, 10, 1000.0), (1001.0, 10, 1000.0), (1.0, 10, 0.0)], "c double, n int, g double")
    assert [r["x"] for r in cost.select(I.catastrophic(F.col("c"), F.col("n"), F.col("g")).alias("x")).collect()] == [0.0, 1.0, None]


def test_nearest_both_ways(spark):
    places = spark.createDataFrame([(k, float(k % 13 * 9 - 60), float(k * 37 % 360 - 180)) for k in range(40)] + [(99, None, None)], "place int, lat double, lon double")
    facilities = spark.createDataFrame([(k, k * 3, float(k * 11 % 120 - 60), float(k * 53 % 360 - 180)) for k in range(12)], "facility int, f_place int, f_lat double, f_lon double")
    a = rows(I.nearest_facility(places, facilities, radii=(800,)).select("place", F.round("min_km", 6), "within_800"))
    b = rows(I.by_cells(places, facilities, radii=(800,), first_km=2000).select("place", F.round("min_km", 6), "within_800"))
    assert [r for r in a if r[0] != 99] == b and (99, None, None) in a
    # Repeated facilities, several at a place's own coordinates, and own ones without a near one: both paths say the same.
    more = facilities.union(facilities).union(spark.createDataFrame([(70, 500, -60.0, -180.0), (71, 0, 10.0, 10.0), (72, 501, None, 1.0)], facilities.schema))
    shown = ("place", F.round("min_km", 6), "nearest", "within_800", "within_3000")
    both = [rows(I.nearest_facility(places, more, (800, 3000), broadcast_rows=n).select(*shown)) for n in (1_000, 0)]
    assert both[0] == both[1] and any(r[3] >= 2 for r in both[0] if r[3])


def test_nearest_works_out_shared_coordinates_once(spark):
    """Copies of places and facilities meet no more than the originals do; counts and own facilities are still whole."""
    places = spark.range(6_000).select(F.col("id").alias("place"), (F.col("id") % 6 * 7).cast("double").alias("lat"), (F.col("id") % 4 * 5).cast("double").alias("lon"))
    facilities = spark.range(3_000).select(F.col("id").alias("facility"), (F.col("id") * 4 + 1).alias("f_place"), (F.col("id") % 10).cast("double").alias("f_lat"), (F.col("id") % 3 * 4).cast("double").alias("f_lon"))
    sites, points = I._sites(places, facilities)
    assert sites.count() == 12 and points.count() == 30 and points.agg(F.sum("n")).first()[0] == 3_000
    km = F.when(F.col("place") == F.col("f_place"), 0.0).otherwise(I.haversine_km(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")))
    some = F.col("place") < 60
    pairs = places.filter(some).crossJoin(facilities).withColumn("km", km)
    plain = rows(pairs.groupBy("place").agg(F.round(F.min("km"), 6), F.min_by("facility", F.struct("km", "facility")), F.count_if(F.col("km") <= 500)))
    for found in (I.nearest_facility(places, facilities, (500,)), I.nearest_facility(places, facilities, (500,), broadcast_rows=0), I.by_cells(places, facilities, (500,))):
        assert rows(found.filter(some).select("place", F.round("min_km", 6), "nearest", "within_500")) == plain and found.count() == 6_000


def test_haversine_query_meets_a_bounded_number_of_coordinates(spark, tmp_path, monkeypatch):
    from panelspark.plans import catalogue

    met = []
    plain = I._meet_by_cells
    monkeypatch.setattr(I, "_meet_by_cells", lambda sites, points, *args: (met.append((sites.count(), points.count())), plain(sites, points, *args))[1])
    spark.range(1, 4_001).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 6_001).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["place"]: r for r in catalogue.QUERIES["nearest_facility_haversine"](spark, str(tmp_path)).collect()}
    assert met == [(360, 2520)] and len(got) == 4_000
    # 361 and 1 share coordinates and have no facility of their own; 15 has one.
    assert got[361][1:] == got[1][1:] and got[15]["min_km"] == 0.0 and got[15]["has_access"] == 1


def test_haversine_query_joins_fewer_pairs_than_places_and_facilities_make(spark, tmp_path):
    """The largest join by its count of rows: of coordinates, not of the places and facilities that share them."""
    from panelspark.plans import catalogue

    spark.range(3_600).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5_040).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    store, java = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    before = {e.executionId() for e in java(store.executionsList())}
    assert len(catalogue.QUERIES["nearest_facility_haversine"](spark, str(tmp_path)).collect()) == 3_600
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    joined = [0]
    for run in {e.executionId() for e in java(store.executionsList())} - before:
        counts = java(store.executionMetrics(run))
        ids = [m.accumulatorId() for node in java(store.planGraph(run).allNodes()) if "Join" in node.name() for m in java(node.metrics()) if m.name() == "number of output rows"]
        joined += [int(counts[i].replace(",", "")) for i in ids if i in counts]
    assert 3_600 <= max(joined) < 20_000  # 5,349 pairs of coordinates within 1,000 km; 106,979 of those that share them


@pytest.mark.parametrize("name", ["nearest_facility_haversine", "nearest_facility_by_cells"])
def test_places_that_share_coordinates_are_dealt_to_all_tasks(spark, tmp_path, name):
    """8,000 places at one point: no task gets half of them, though AQE doesn't split and joins aren't broadcast by size."""
    from panelspark.plans import catalogue

    spark.range(1, 8_001).select((F.col("id") * 360).alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 51).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    places, facilities = catalogue.places(spark, str(tmp_path))
    km = F.when(F.col("place") == F.col("f_place"), 0.0).otherwise(I.haversine_km(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")))
    plain = rows(places.crossJoin(F.broadcast(facilities)).withColumn("km", km).groupBy("place").agg(F.round(F.min("km"), 6), F.count_if(F.col("km") <= 500)))
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(f"dealt {name}", "")
        assert rows(catalogue.QUERIES[name](spark, str(tmp_path)).select("place", "min_km", "within_500")) == plain
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store, java = sc.statusTracker(), sc._jsc.sc().statusStore(), sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    stages = {i for job in tracker.getJobIdsForGroup(f"dealt {name}") for i in tracker.getJobInfo(job).stageIds}
    read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for i in stages for t in java(store.taskList(i, 0, 1_000)) if t.taskMetrics().isDefined()]
    assert 1_000 < max(read) < 5_000


def test_a_place_listed_twice_is_one_row(spark):
    """As by GROUP BY: its counts are those of both, whichever way facilities are met."""
    places = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 1.0), (3, None, None)], "place int, lat double, lon double")
    facilities = spark.createDataFrame([(7, 2, 0.0, 2.0), (8, 9, 0.0, 1.0)], "facility int, f_place int, f_lat double, f_lon double")
    for n in (1_000, 0):
        got = rows(I.nearest_facility(places, facilities, (150,), broadcast_rows=n).select("place", "nearest", "within_150"))
        assert got == [(1, 8, 2), (2, 7, 2), (3, None, None)]


def regression_frame(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    entity, period = np.repeat(np.arange(n // 6), 6), np.tile(np.arange(6), n // 6)
    x = rng.normal(size=n) + entity * 0.3
    y = 2.0 * x + entity + 0.5 * period + rng.normal(size=n) * (1 + abs(x))
    return spark.createDataFrame([(int(e), int(p), float(a), float(b)) for e, p, a, b in zip(entity, period, x, y, strict=True)], "e int, p int, x double, y double"), entity, period, x, y


def test_hc3_by_hand(spark):
    df, _, _, x, y = regression_frame(spark)
    X = np.column_stack([np.ones_like(x), x])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = (y - X @ b) / (1 - np.einsum("ij,jk,ik->i", X, inv, X))
    se = np.sqrt(np.diag(inv @ (X * e[:, None] ** 2).T @ X @ inv))
    fit = S.ols_hc3(df, "y", ["x"])
    assert fit.coef == pytest.approx(b) and fit.se == pytest.approx(se)


def test_fixed_effects_against_dummies(spark):
    df, entity, period, x, y = regression_frame(spark)
    D = np.column_stack([x, np.eye(entity.max() + 1)[entity], np.eye(6)[period][:, 1:]])
    b = np.linalg.lstsq(D, y, rcond=None)[0]
    fit = S.fixed_effects(df, "y", ["x"], "e", "p")
    assert fit.coef[0] == pytest.approx(b[0])

    def clustered(x, y, entity, period, b):
        """Cluster-robust error and R2s, about zero, from dense demeaning by dummies."""
        D = np.column_stack([np.eye(entity.max() + 1)[entity], np.eye(6)[period][:, 1:]])
        out = lambda v, M: v - M @ np.linalg.lstsq(M, v, rcond=None)[0]
        wx, wy = out(x, D), out(y, D)
        g, n = len(np.unique(entity)), len(x)
        u = np.array([(wx * (wy - b * wx))[entity == k].sum() for k in np.unique(entity)])
        share = lambda p, q: 1 - ((q - b * p) ** 2).sum() / (q**2).sum()
        E = D[:, : entity.max() + 1]
        mx, my = (np.array([v[entity == k].mean() for k in np.unique(entity)]) for v in (x, y))
        return np.sqrt((u**2).sum() * g / (g - 1)) / (wx**2).sum(), share(wx, wy), share(out(x, E), out(y, E)), share(mx, my), share(x, y)

    assert (fit.se[0], fit.r2, fit.r2_within, fit.r2_between, fit.r2_overall) == pytest.approx(clustered(x, y, entity, period, b[0]))
    unbalanced = df.filter("NOT (e = 2 AND p > 2) AND NOT (e = 4 AND p = 0)")
    keep = ~(((entity == 2) & (period > 2)) | ((entity == 4) & (period == 0)))
    b = np.linalg.lstsq(D[keep], y[keep], rcond=None)[0]
    fit = S.fixed_effects(unbalanced, "y", ["x"], "e", "p")
    assert fit.coef[0] == pytest.approx(b[0], rel=1e-9)
    assert (fit.se[0], fit.r2, fit.r2_within, fit.r2_between, fit.r2_overall) == pytest.approx(clustered(x[keep], y[keep], entity[keep], period[keep], b[0]))
    assert S.fixed_effects(df.limit(5), "y", ["x"], "e", "p") is None


def test_morans_i_of_a_line(spark):
    values = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, value double")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "src int, dst int, w double")
    z = np.arange(6) - 2.5
    w = np.array([[1.0 if abs(i - j) == 1 else 0 for j in range(6)] for i in range(6)])
    w /= w.sum(axis=1, keepdims=True)
    assert S.morans_i(values, edges).first()["morans_i"] == pytest.approx((z @ w @ z) / (z @ z))
    test = S.morans_test(values, edges, permutations=9).first()
    assert test["morans_i"] == pytest.approx((z @ w @ z) / (z @ z)) and 0 < test["p"] <= 1
    assert S.morans_test(values.limit(0), edges).count() == 0


def test_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(20)], "i int, g int")
    folds = M.group_folds(df, "g", 3)
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0 and folds.select("fold").distinct().count() == 3


def test_imputation_fills_only_gaps(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(a), None if i % 5 == 0 else float(2 * a + rng.normal() * 0.1)) for i, a in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(data, "k int, a double, b double")
    out = {r["k"]: r for r in imputation.impute(df, ["b"], ["a"], ["k"], draws=2, sweeps=2).collect()}
    assert all(out[k]["b"] == b for k, _, b in data if b is not None) and all(out[k]["is_imputed"] == int(b is None) for k, _, b in data)
    assert all(abs(out[k]["b"] - 2 * a) < 1.0 for k, a, b in data if b is None)


def test_facilities_beyond_400_are_met(spark, tmp_path):
    from panelspark.plans import catalogue

    spark.range(1, 301).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 701).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    sites = [(s * 15, s * 13 % 140 - 70, s * 31 % 360 - 180) for s in range(1, 701)]

    def km(place, f_place, lat, lon, f_lat, f_lon):
        h = math.sin((math.radians(f_lat) - math.radians(lat)) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(f_lat)) * math.sin(math.radians(f_lon - lon) / 2) ** 2
        return 0.0 if place == f_place else 2 * 6371 * math.asin(math.sqrt(min(1, h)))

    for name in ("nearest_facility_haversine", "nearest_facility_by_cells"):
        for row in catalogue.QUERIES[name](spark, str(tmp_path)).collect():
            p = row["place"]
            all_km = [km(p, f, p % 120 - 60, p * 7 % 360 - 180, lat, lon) for f, lat, lon in sites]
            assert row["min_km"] == pytest.approx(min(all_km), abs=1e-4)
            for field in set(row.asDict()) & {"within_500", "within_1000"}:
                assert row[field] == sum(k <= int(field[7:]) for k in all_km)


def test_pivots_have_every_period_present(spark):
    from panelspark.plans import catalogue

    d = "/root/testdata/sf0.001"
    years = [r[0] for r in catalogue.regional(spark, d).select("period").distinct().orderBy("period").collect()]
    got = catalogue.QUERIES["region_year_median_pivot"](spark, d)
    assert len(years) > 3 and got.columns == ["r_name", *(f"y{y}" for y in years)]
    medians = {(r[0], r[1]): r[2] for r in catalogue.regional(spark, d).groupBy("r_name", "period").agg(F.median("o_totalprice")).collect()}
    assert all(r[f"y{y}"] == pytest.approx(medians[r["r_name"], y], abs=1e-3) for r in got.collect() for y in years if (r["r_name"], y) in medians)
    gaps = catalogue.with_gaps(spark, d)
    years = [r[0] for r in gaps.filter("period IS NOT NULL").select("period").distinct().orderBy("period").collect()]
    wide = catalogue.QUERIES["missingness_wide"](spark, d)
    assert wide.columns == ["variable", *(f"y{y}" for y in years), "overall"]
    long = {(r["variable"], r["period"]): r["pct_missing"] for r in catalogue.QUERIES["missingness_long"](spark, d).collect()}
    assert all(r[f"y{y}"] == long[r["variable"], y] for r in wide.collect() for y in years)


def test_percentiles_of_large_groups_equal_exact_ones(spark, monkeypatch):
    """Brackets and counts against numpy, with ties, nulls, a null key and small groups. Brackets are wider, as groups are smaller."""
    monkeypatch.setattr(N, "BRACKET_SHARE", 0.02)
    rng = np.random.default_rng(4)
    data = [(None if i % 7 == 0 else i % 3, float(v), None if i % 11 == 0 else float(round(v, 1))) for i, v in enumerate(rng.normal(size=6_000))] + [(9, 1.0, None), (9, 3.0, 2.0)]
    df = spark.createDataFrame(data, "k int, a double, b double")
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for keys, bracket in ((["k"], 500), (["k"], 20_000), ([], 0)):
        got = {r["k"] if keys else "all": r for r in N.percentiles(df, ["a", "b"], points, keys, group_rows=0, bracket_rows=bracket).collect()}
        for key in {k for k, _, _ in data} if keys else {"all"}:
            for j, c in ((1, "a"), (2, "b")):
                own = [r[j] for r in data if (not keys or r[0] == key) and r[j] is not None]
                assert got[key][f"_q_{c}"] == pytest.approx(np.quantile(own, points).tolist())


def shuffled_by(spark, work):
    """What work() returns, and the largest number of rows that one of its stages read from a shuffle."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    before = {s.stageId() for s in stages()}
    found = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return found, max(s.shuffleReadRecords() for s in stages() if s.stageId() not in before)


def test_bins_of_large_tables_move_none_of_their_rows(spark, monkeypatch):
    """Least and largest values are brackets of their own, and brackets are sent to the rows instead of joined by a shuffle."""
    monkeypatch.setattr(N, "BRACKET_SHARE", 0.002)
    n = 40_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"), (F.col("id") % 2).alias("k"))
    for keys in ([], ["k"]):
        points = [0.0, 0.25, 0.5, 0.75, 1.0]
        got, most = shuffled_by(spark, lambda keys=keys, points=points: N.percentiles(df, ["x"], points, keys, group_rows=100, bracket_rows=0).collect())
        values = [np.arange(k, n, 2) if keys else np.arange(n) for k in range(2 if keys else 1)]
        assert sorted(r["_q_x"] for r in got) == [pytest.approx(np.quantile(v, points).tolist()) for v in values] and most < n / 20
    # Groups beside a large one are left to Spark's percentile.
    mixed = df.withColumn("k", F.when(F.col("x") < 5, F.lit(None)).otherwise(F.lit(1)))
    got = {r["k"]: r["_q_x"] for r in N.percentiles(mixed, ["x"], [0.0, 0.5], ["k"], group_rows=100, bracket_rows=0).collect()}
    assert got == {None: [0.0, 2.0], 1: [5.0, (n - 1 + 5) / 2]}


def test_dose_response_of_a_large_table_moves_none_of_its_rows(spark, monkeypatch):
    """Few values, each repeated often: bins by their edges against a plain loop, whoever picks the percentiles."""
    n = 40_000
    df = spark.range(n).select((F.col("id") % 50 + 1).cast("double").alias("x"), (F.col("id") % 977).cast("double").alias("y"))
    small = rows(A.dose_response(df, "x", "y", 10).select("bin", "n", F.round("mean_x", 6), F.round("mean_y", 6), F.round("sem", 6)))
    monkeypatch.setattr(N, "percentiles", partial(N.percentiles, group_rows=100, bracket_rows=0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables whose size Spark doesn't take for small
    try:
        large, most = shuffled_by(spark, lambda: rows(A.dose_response(df, "x", "y", 10).select("bin", "n", F.round("mean_x", 6), F.round("mean_y", 6), F.round("sem", 6))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    x = np.arange(n) % 50 + 1.0
    edges = np.unique(np.quantile(x, [k / 10 for k in range(11)]))
    bins = np.maximum(np.searchsorted(edges, x) - 1, 0)
    assert large == small and [r[1] for r in large] == np.bincount(bins).tolist() and most < n / 20


def test_dose_response_of_a_large_table_reads_it_four_times(spark, tmp_path, monkeypatch):
    """To count it, to sketch its brackets, to count within and between them, and for the bins; points may come in any order."""
    n = 40_000
    spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"), F.col("id").cast("double").alias("y")).write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(N, "BRACKET_SHARE", 0.002)
    plain = N.percentiles
    monkeypatch.setattr(N, "percentiles", partial(plain, group_rows=100, bracket_rows=0))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    before = {s.stageId() for s in stages()}
    got = rows(A.dose_response(df, "x", "y", 10).select("bin", "n"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(s.inputRecords() for s in stages() if s.stageId() not in before) <= 4 * n + 100
    assert got == [(k, n // 10) for k in range(10)]
    points = [0.75, 0.0, 0.7501, 1.0, 0.5]  # two of them within one bracket
    assert plain(df, ["x"], points, group_rows=100, bracket_rows=0).first()["_q_x"] == pytest.approx(np.quantile(np.arange(n), points).tolist())


def test_ranks_in_ranges_equal_plain_ranks(spark):
    values = [5, 1, 1, 3, None, 3, 3, 10, -4, 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    known = sorted(v for v in values if v is not None)
    for parts in (1, 3, 64):
        got = {r["i"]: r["rank"] for r in A.average_ranks(df, "v", "rank", parts).collect()}
        assert got == {i: None if v is None else known.index(v) + (known.count(v) + 1) / 2 for i, v in enumerate(values)}


def test_lasso_meets_its_conditions_and_double_ml_equals_dense(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
    d = x[:, 0] + rng.normal(size=n)
    y = 2 * d + x[:, 1] + rng.normal(size=n)
    X = np.column_stack([np.ones(n), x, y])
    b = M.lasso(X.T @ X, 0.1)
    residual = y - b[0] - x @ b[1:]
    slope = (x - x.mean(0)) / x.std(0)
    pull = slope.T @ residual / n
    assert abs(residual.mean()) < 1e-9 and all(abs(p - 0.1 * np.sign(c)) < 1e-8 if c else abs(p) <= 0.1 + 1e-8 for p, c in zip(pull, b[1:], strict=True))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack([x, d, y]))], "i int, a double, b double, c double, d double, y double")
    found = M.double_ml(df, "y", "d", ["a", "b", "c"], ["i"], penalty=0.05)
    fold = np.array([r["fold"] for r in M.hash_folds(df, ["i"]).orderBy("i").collect()])
    ry, rd = np.zeros(n), np.zeros(n)
    for k in range(5):
        for v, out in ((y, ry), (d, rd)):
            t = fold != k
            Z = np.column_stack([np.ones(t.sum()), x[t], v[t]])
            w = M.lasso(Z.T @ Z, 0.05)
            out[~t] = v[~t] - w[0] - x[~t] @ w[1:]
    effect = (rd @ ry) / (rd @ rd)
    assert found["effect"] == pytest.approx(effect) and found["se"] == pytest.approx(np.sqrt((rd**2 * (ry - effect * rd) ** 2).sum()) / (rd @ rd))
    chosen = M.double_ml(df, "y", "d", ["a", "b", "c"], ["i"])
    assert abs(chosen["effect"] - 2) < 0.2 and M.double_ml(df.limit(10), "y", "d", ["a"], ["i"]) is None


def test_fold_metrics_and_their_summary(spark):
    rng = np.random.default_rng(1)
    data = [(i % 4, float(a), float(3 * (a > 0) + rng.normal() * 0.1)) for i, a in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(data, "g int, x double, y double")
    folds = M.cross_validate(df, ["x"], "y", "g", "rf", trees=5, folds=4)
    assert [r["fold"] for r in folds.orderBy("fold").collect()] == [0, 1, 2, 3] and all(r["r2"] > 0.9 and r["rmse"] < 0.5 for r in folds.collect())
    r2 = np.array([r["r2"] for r in folds.collect()])
    row = {r["metric"]: r for r in M.fold_summary(folds).collect()}["r2"]
    half = 3.182446305284264 * r2.std(ddof=1) / 2
    assert (row["n"], row["mean"], row["ci_low"], row["ci_high"]) == pytest.approx((4, r2.mean(), r2.mean() - half, r2.mean() + half))
    shares = {r["feature"]: r["importance"] for r in M.importances(df.withColumn("noise", F.lit(1.0)), ["x", "noise"], "y", trees=5).collect()}
    assert shares["x"] == pytest.approx(1.0) and shares["noise"] == 0.0
    assert M.refit(df, ["x"], "y", trees=3).numFeatures == 1


def test_small_panel_operators(spark):
    df = spark.createDataFrame([(" 12", "north", None, 4.0, "b"), ("0000013", "south", 2.0, None, "a"), ("14", "west", None, 0.0, None)], "Code string, zone string, v double, w double, kind string")
    keyed = P.canonical_key(df, "entity", ["code"])
    assert [r["entity"] for r in keyed.collect()] == ["0000012", "0000013", "0000014"]
    with pytest.raises(ValueError, match="no column"):
        P.canonical_key(df, "entity", ["absent"])
    assert P.prefixed(df, "s_", ["Code"]).columns == ["Code", "s_zone", "s_v", "s_w", "s_kind"]
    assert X.usd(F.col("v"), 0) is None and df.select(X.usd(F.col("v"), 4.0).alias("u")).collect()[1]["u"] == 0.5
    assert [r["v"] for r in I.region_proxy(df, "v", "zone", {"north": 7.0}, 1.0).collect()] == [7.0, 2.0, 1.0]
    hot = A.one_hot(df, "kind", ["a", "b"])
    assert [(r["kind_a"], r["kind_b"]) for r in hot.collect()] == [(0, 1), (1, 0), (0, 0)]
    assert [r["kind"] for r in A.in_order(df, "kind", ["b", "a"]).collect()] == ["b", "a", None]
    flags = I.target_flags(df, {"v": 2.0}, {"w": 1.0}).collect()
    assert [(r["meets_v"], r["meets_w"]) for r in flags] == [(0, 0), (1, 0), (0, 1)]
    gaps = A.target_gaps(df, "w", 3.0, "Code").collect()
    assert [(r["gap"], r["meets"]) for r in gaps] == [(3.0, 0), (-1.0, 1)]
    assert [r["d"] for r in df.select(I.people_density(F.col("w"), F.col("v")).alias("d")).collect()] == [None, None, None]
    p = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.5,)], "p double")
    assert [r[0] for r in p.select(X.stars(F.col("p"))).collect()] == ["***", "**", "*", ""]


def test_quarantine_names_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(str(k), 2020) for k in range(30)] + [("a", 1900), ("a", 2020), ("a", 2020)], "e string, y int")
    clean, bad, report = Q.validate(df, spark.createDataFrame([("a",)], "e string"), "e", "y", 2000, 2030, "census")
    assert report.samples["invalid_entity"] == sorted(map(str, range(30)))[:10] and not report.passed and clean.count() == 1
    assert bad.filter("_quarantine_at IS NULL OR _quarantine_source <> 'census'").count() == 0
    Q.write_quarantine(bad, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).filter("_quarantine_reason = 'duplicate_key'").count() == 1
    Q.write_report(spark, report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/json")).first()["n_rows"] == 33
    assert spark.read.option("header", True).csv(str(tmp_path / "report/csv")).count() == 3
    seen = []
    Q.gated([("one", lambda x: x.limit(2)), ("two", lambda x: x.limit(1))], df, lambda name, x: seen.append((name, x.count())))
    assert seen == [("one", 2), ("two", 1)]


def test_reference_list_guard(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert Q.require_reference(df, "k", 2) is df
    for bad, rows in ((df, 3), (df.union(df.limit(1)), 3), (df.union(spark.createDataFrame([(None, 1)], df.schema)), 3)):
        with pytest.raises(Q.ValidationError):
            Q.require_reference(bad, "k", rows)


def test_dictionary_statuses(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b double, c string")
    got = {r["column"]: (r["status"], r["pct_missing"]) for r in Q.check_dictionary(df, {"a": "int", "b": "double", "c": "int", "d": "date"}).collect()}
    assert got == {"a": ("ok", 0.0), "b": ("empty", 100.0), "c": ("type", 50.0), "d": ("absent", None)}
    assert {r["status"] for r in Q.check_dictionary(df, {}).collect()} == {"undocumented"}


def test_chained_index_and_rates(spark):
    changes = spark.createDataFrame([(2020, 2, 10.0), (2020, 1, None), (2020, 3, -50.0)], "y int, m int, c double")
    assert [r["index"] for r in P.chain_index(changes, ["y", "m"], "c").orderBy("m").collect()] == pytest.approx([100, 110, 55])
    rates = spark.createDataFrame([("2020-01-01", 2.0), ("2020-12-31", 4.0), ("2020-06-01", None), (None, 9.0)], "d string, r double").withColumn("d", F.to_date("d"))
    assert [tuple(r) for r in P.annual_rates(rates, "d", "r", 2.0).collect()] == [(2020, 1.5, 2.0)]


def test_join_by_name_keeps_rows_without_a_match(spark):
    left = spark.createDataFrame([("Ab", "x"), ("Ab", "y"), (None, "x")], "n string, g string")
    right = spark.createDataFrame([(" ab ", "x", 1), ("zz", "x", 2)], "m string, h string, v int")
    assert sorted(P.join_by_name(left, right, "n", "g", "m", "h").collect(), key=str) == [("Ab", "x", 1), ("Ab", "y", None), (None, "x", None)]


def test_mechanisms_and_interpretation(spark):
    df = spark.createDataFrame([(1, None, 2.0, None), (1, 1.0, 2.0, None)], "p int, a double, b double, src_c double").withColumn("fixed_d", F.col("a"))
    got = {r["variable"]: (r["mechanism"], r["handling"]) for r in A.with_mechanism(A.missingness(df, ["a", "b", "src_c", "fixed_d"], "p"), {"fixed_": "F"}, ["src_"], {"F": "fill", "NA": "none"}).collect()}
    assert got == {"a": ("MAR", "left_as_missing"), "b": ("NA", "none"), "src_c": ("source_unavailable", "left_as_missing"), "fixed_d": ("F", "fill")}
    tests = spark.createDataFrame([(0.3, 0.01), (-0.2, 0.04), (0.3, 0.2), (0.1, None)], "morans_i double, p double")
    assert [r["interpretation"] for r in S.with_interpretation(tests).collect()] == ["positive spatial autocorrelation", "negative spatial autocorrelation", "no significant autocorrelation", None]
    values = spark.createDataFrame([(i, float(i)) for i in range(3)], "id int, value double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src int, dst int, w double")
    assert S.morans_test(values, edges).count() == 0


def test_trends_and_winsorised_composite(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, None), (2, None, 7.0)], "p int, a double, b double")
    got = {r["p"]: r.asDict() for r in A.trends(df, "p", ["a"], ["b"], ["a"], ["b"]).collect()}
    assert got[1] == {"p": 1, "mean_a": 2.0, "sum_a": 4.0, "n_b": 1, "median_b": 5.0} and got[2] == {"p": 2, "mean_a": None, "sum_a": None, "n_b": 1, "median_b": 7.0}
    rows = spark.createDataFrame([(float(i), float(i)) for i in range(101)] + [(None, 100.0), (None, None)], "a double, b double")
    scored = {(r["a"], r["b"]): r["score"] for r in I.winsorised_composite(rows, ["a", "b"], ["b"]).collect()}
    assert scored[None, None] is None and scored[None, 100.0] == pytest.approx(0.001) and scored[50.0, 50.0] == pytest.approx(0.5, abs=0.02)


def test_correlations_with_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 2.0, 4.0), (3.0, None, 9.0), (None, 7.0, 1.0)], "a double, b double, c double")
    got = {(r["x"], r["y"]): (r["r"], r["n"]) for r in A.correlations(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (None, 2) and got["a", "c"][0] == pytest.approx(np.corrcoef([1, 2, 3], [5, 4, 9])[0, 1])
    assert A.spearman(df, "a", "b").first()["rho"] is None
