import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import exprs as X
from panelspark.functions import quantiles as Qn


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_null_rules(spark):
    null = F.lit(None).cast("double")
    got = one(spark, div=X.safe_div(F.lit(1), F.lit(0)), keep=X.clip_keep_null(null, 0, 1), clip=X.clip_keep_null(F.lit(1.5), 0, 1), bad=X.number(F.lit("x")), nan=X.number(F.lit("NaN")), flag=X.flag(null > 1))
    assert got.asDict() == {"div": None, "keep": None, "clip": 1.0, "bad": None, "nan": None, "flag": 0}


@pytest.mark.parametrize(("code", "want"), [("123", "0000123"), (" 3550308 ", "3550308"), ("12345678", "12345678")])
def test_codes_are_padded_never_cut(spark, code, want):
    assert one(spark, c=X.normalize_code(F.lit(code)))["c"] == want


@pytest.mark.parametrize(("age", "unit", "want"), [("40", "4", 40), ("30", "3", 2), ("20", "2", 0), (None, None, 0), ("-3", "4", 0)])
def test_age_units(spark, age, unit, want):
    assert one(spark, a=X.age_years(F.lit(age).cast("string"), F.lit(unit).cast("string")))["a"] == want


def test_bands_are_closed_on_the_left(spark):
    got = spark.createDataFrame([(0,), (4,), (5,), (79,), (80,), (120,)], "a int").select(X.band_label(F.col("a")).alias("b")).collect()
    assert [g["b"] for g in got] == ["0-4", "0-4", "5-9", "75-79", "80+", "80+"]


def test_geometric_mean_skips_nulls(spark):
    null = F.lit(None).cast("double")
    got = one(spark, a=X.geometric_mean([F.lit(0.2), F.lit(0.8), null]), b=X.geometric_mean([null, null]))
    assert got["a"] == pytest.approx(math.exp((math.log(0.21) + math.log(0.81)) / 2) - 0.01) and got["b"] is None


def test_haversine(spark):
    # Two cities about 360 km apart.
    assert one(spark, d=X.haversine_km(F.lit(-23.5505), F.lit(-46.6333), F.lit(-22.9068), F.lit(-43.1729)))["d"] == pytest.approx(360.7, abs=1.0)


def test_wilson(spark):
    low, high = X.wilson(F.lit(5), F.lit(10))
    none, _ = X.wilson(F.lit(0), F.lit(0))
    got = one(spark, low=low, high=high, none=none)
    assert (got["low"], got["high"]) == pytest.approx((0.2366, 0.7634), abs=1e-4) and got["none"] is None


def test_quantiles():
    assert Qn.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-6)
    assert Qn.normal_quantile(0.975) == pytest.approx(X.Z95)
    assert Qn.chi2_quantile(0.95, 3) == pytest.approx(7.814728, abs=1e-6)
    assert Qn.poisson_bounds(0) == pytest.approx((0.0, 3.688879), abs=1e-6)
    assert Qn.poisson_bounds(10) == pytest.approx((4.795389, 18.390356), abs=1e-5)
    assert Qn.two_sided_t(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
