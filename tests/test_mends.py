"""Missing numbers, orders of autoregressive errors, and curves beside a random effect."""

import math
import random

import pytest

from tarnis.operators.frame import zscore
from tarnis.operators.summary import annual_summary, corr_matrix, histogram, summary6, summary_quartiles, temporal_ranges
from tarnis.plans.season import choose_order
from tarnis.smooth import gam, re, s
from tarnis.smooth.fit import AR


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(float(i), f"{2000 + i % 3}-01-0{1 + i % 9}") for i in range(60)]
    return spark.createDataFrame([*rows, *[(math.nan, "2000-01-01")] * 5], "x double, d string").selectExpr("x", "to_date(d) AS d")


def test_nan_is_no_value_in_summaries(gaps):
    r = summary6(gaps, "x").first()
    assert (r["mean"], r["min"], r["max"], r["count"]) == (29.5, 0.0, 59.0, 65) and not math.isnan(r["sd"])
    assert all(not math.isnan(r["mean"]) and r["max"] <= 59 for r in annual_summary(gaps, "x", "d").collect())
    assert sum(r["n"] for r in histogram(gaps, ["x"]).collect()) == 60 and histogram(gaps, ["x"]).count() > 20


def test_nan_is_refused_where_missing_rows_are(spark):
    rnd = random.Random(1)
    rows = [(rnd.random(), rnd.gauss(0, 1)) for _ in range(200)] + [(math.nan, 1.0)]
    with pytest.raises(ValueError, match="missing"):
        gam(spark.createDataFrame(rows, "x double, y double"), "y", [s("x", k=4)], na="fail")


def test_independent_errors_need_no_order(spark):
    rnd = random.Random(3)
    rows = [(2000 + i // 200, i, rnd.random(), rnd.gammavariate(5, 0.4)) for i in range(800)]
    df = spark.createDataFrame(rows, "year int, i int, x double, y double")
    models = {p: gam(df, "y", [s("x", k=4)], family="gamma", ar=AR(p, "year", ("i",), True)) for p in (0, 1)}
    assert abs(models[0].loglik - models[1].loglik) < 3
    assert choose_order(models)[0] == 0


def test_curves_beside_a_random_effect(spark):
    rnd = random.Random(2)
    rows = [(rnd.random(), g, rnd.gauss(0, 0.1)) for g in "aab" * 100]
    model = gam(spark.createDataFrame([(x, g, x * x + (g == "b") + e) for x, g, e in rows], "x double, g string, y double"), "y", [s("x", k=5), re("g")])
    assert model.change("s(x)", n=20).count() == 20
    assert {r["g"] for r in model.line("x", n=5).collect()} == {"a"}


def test_nan_is_missing_in_scores_ranges_and_correlations(spark):
    rows = [(float(i), float(i * i % 7), 2000 + i % 3, "a" if i % 2 else "b") for i in range(30)]
    clean = spark.createDataFrame(rows, "x double, y double, year int, g string")
    holes = clean.unionByName(spark.createDataFrame([(math.nan, 1.0, 2000, "a"), (2.0, math.nan, 2001, "b"), (None, None, 2002, "a")], clean.schema))
    z = zscore(holes, ["x"]).collect()
    assert sum(r.x is None for r in z) == 2 and abs(sum(r.x for r in z if r.x is not None)) < 1e-9
    assert all(r.x is None or not math.isnan(r.x) for r in zscore(holes, ["x", "y"], ["g"]).collect())
    assert temporal_ranges(holes.where("y IS NULL OR NOT isnan(y)"), "x").first() == temporal_ranges(clean, "x").first()
    assert summary_quartiles(holes, "x").first()["nulls"] == 2 and summary_quartiles(holes, "x").first()["max"] == 29
    both = clean.unionByName(spark.createDataFrame([(math.nan, 1.0, 2000, "a")], clean.schema))
    assert corr_matrix(both, ["x", "y"]).first()["corr"] == pytest.approx(corr_matrix(clean, ["x", "y"]).first()["corr"])
