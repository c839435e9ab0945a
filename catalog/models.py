"""Additive models on the given tables. Smoothing parameters are found by iteration, which SQL cannot
say; the parts that SQL can (cross-products, unpenalised fits) are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tarnis.operators.series import correlogram
from tarnis.plans import season
from tarnis.smooth import check, gam, linear, re, s, te, ti
from tarnis.smooth.fit import AR, prepare, run_pass
from tarnis.smooth.family import Gaussian
from tarnis.smooth.terms import Design, Smooth
from tarnis.smooth.bases import LineBasis

DOY = season.DOY_KNOTS


def readings(spark, d, *keys):
    """Line items as readings: quantity is positive, `load` has many exact zeros."""
    return table(spark, d, "lineitem").select(
        *keys,
        F.year("l_shipdate").alias("year"),
        F.dayofyear("l_shipdate").alias("DOY"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_discount") * F.col("l_quantity")).alias("load"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("flow"),
        F.col("l_returnflag").alias("flag"),
    )


def daily(spark, d):
    """Daily means: one row per day, the form of the models with autoregressive errors."""
    df = readings(spark, d)
    return df.groupBy("date", "year", "DOY").agg(F.avg("quantity").alias("quantity"), F.avg("tax").alias("tax"))


def season_terms(k_year=6):
    return [
        s("DOY", bs="cc", k=12, knots=DOY),
        s("year", bs="cr", k=k_year),
        ti("DOY", "year", bs=("cc", "cr"), knots=DOY),
    ]


def _fit_season(spark, d, family="gamma", **options):
    return gam(readings(spark, d), "quantity", season_terms(), family=family, **options)


_GRAM = ["1.0", "l_quantity", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round(sum({a} * {b}), 5) AS value FROM lineitem"
        for i, a in enumerate(_GRAM)
        for j, b in enumerate(_GRAM)
    )
)
def gram_matrix(spark, d):
    """Cross-products of a linear design, summed by the pass every model fit is made of."""
    variables = ["l_quantity", "l_discount", "l_tax"]
    frame = prepare(table(spark, d, "lineitem"), "l_extendedprice", variables, Gaussian(), set(), None)
    smooths = [Smooth(linear(v), [i], [LineBasis()], [None]) for i, v in enumerate(variables)]
    gram = run_pass(frame, Design(smooths, variables).place(), Gaussian(), None).gram
    frame.cells.unpersist()
    rows = [(i, j, float(gram[i, j])) for i in range(4) for j in range(4)]
    return rounded(spark.createDataFrame(rows, "i int, j int, value double"), 5)


@query(
    """SELECT '(Intercept)' AS coefficient, round(regr_intercept(l_extendedprice, l_quantity) / 1000, 6) AS estimate FROM lineitem
    UNION ALL SELECT 'l_quantity.1', round(regr_slope(l_extendedprice, l_quantity) / 1000, 6) FROM lineitem"""
)
def gam_linear(spark, d):
    """A model without smooths is least squares."""
    model = gam(table(spark, d, "lineitem"), "l_extendedprice / 1000", [linear("l_quantity")])
    return rounded(model.coefficients().select("coefficient", "estimate"))


@query()
def gam_gaussian(spark, d):
    return _fit_season(spark, d, "gaussian").summary()


@query()
def gam_gamma(spark, d):
    return _fit_season(spark, d).statistics()


@query()
def gam_summary(spark, d):
    return _fit_season(spark, d).summary()


@query()
def gam_inverse_gaussian(spark, d):
    return _fit_season(spark, d, "inverse_gaussian").statistics()


@query()
def gam_scaled_t(spark, d):
    model = gam(readings(spark, d), "quantity", [s("DOY", bs="cc", k=8, knots=DOY)], family="scaled_t", nu=6.0)
    return model.statistics()


def predictor_model(spark, d, **options):
    settings = {"family": "tweedie", "power": 1.5, "select": True} | options
    terms = [s("flow", k=10), s("sqrt(tax)", k=6), te("year", "DOY", bs=("cr", "cc"), k=(5, 8), knots=DOY)]
    return gam(readings(spark, d), "load", terms, **settings)


@query()
def gam_tweedie(spark, d):
    return predictor_model(spark, d).statistics()


@query()
def gam_tweedie_power(spark, d):
    model = gam(readings(spark, d), "load", [s("flow", bs="cr", k=5)], family="tweedie", power="estimate")
    return model.statistics()


@query()
def gam_select_ml(spark, d):
    return _fit_season(spark, d, method="ML", select=True).summary()


@query()
def gam_random_effect(spark, d):
    model = gam(readings(spark, d), "quantity", [s("DOY", bs="cc", k=12, knots=DOY), re("flag")], family="gamma")
    return model.summary()


@query()
def gam_ar1(spark, d):
    model = gam(daily(spark, d), "quantity", season_terms(), family="gamma", ar=AR(1, "year", ["date"], bounded=True))
    return model.statistics()


@query()
def gam_ar_orders(spark, d):
    models = season.fit_season(daily(spark, d), "quantity", ["date"], max_ar=2, k_year=6, bounded=True)
    return season.choose_order(models)[1]


@query()
def gam_predict_ci(spark, d):
    """Prediction with an interval on every row, summed up by year."""
    df = readings(spark, d)
    made = _fit_season(spark, d).predict(df, scale="response")
    return made.groupBy("year").agg(*[F.avg(c).alias(c) for c in ("fit", "lower", "upper", "se")])


@query()
def gam_terms(spark, d):
    df = readings(spark, d).select("year", "DOY").distinct()
    return _fit_season(spark, d).predict_terms(df, "ti(DOY,year)")


@query()
def gam_curves(spark, d):
    return _fit_season(spark, d).seasonal_curves()


@query()
def gam_surface(spark, d):
    return _fit_season(spark, d).response_surface("ti(DOY,year)", n=60)


@query()
def gam_obs_pred(spark, d):
    df = readings(spark, d)
    long = _fit_season(spark, d).observed_vs_predicted(df, ["date"])
    return long.groupBy("date", "fit").agg(F.avg("value").alias("value"))


@query()
def gam_derivative(spark, d):
    return _fit_season(spark, d).change("s(year)")


@query()
def gam_change_periods(spark, d):
    """Periods in which the number of line items per day rose or fell along the years."""
    counts = readings(spark, d).groupBy("year", "DOY").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("time", F.col("year") + F.col("DOY") / 366)
    terms = [s("time", bs="cr", k=20), s("DOY", bs="cc", k=12, knots=DOY)]
    return season.change_report(gam(counts, "n", terms, family="gamma"), "s(time)")


@query()
def gam_compare(spark, d):
    a = _fit_season(spark, d)
    b = gam(readings(spark, d), "quantity", season_terms()[:2], family="gamma")
    return check.compare({"interaction": a, "main effects": b}, "BIC")


@query()
def gam_lrt(spark, d):
    a = gam(readings(spark, d), "quantity", season_terms()[:2], family="gamma")
    return check.lrt(a, _fit_season(spark, d))


@query()
def gam_drop(spark, d):
    full = _fit_season(spark, d, "gaussian")
    return check.compare({"full": full, **check.drop_terms(full, ["s(DOY)", "s(year)", "ti(DOY,year)"])})


@query()
def gam_diagnostics(spark, d):
    df = readings(spark, d)
    rows = check.diagnostics(_fit_season(spark, d), df)
    return rows.groupBy("year").agg(
        *[F.avg(c).alias(c) for c in ("observed", "fitted", "linear_predictor", "deviance", "pearson")]
    )


@query()
def gam_qq(spark, d):
    df = daily(spark, d)
    model = gam(df, "quantity", season_terms(), family="gamma")
    return check.qq_points(model, df, ["date"])


@query()
def gam_residual_histogram(spark, d):
    df = daily(spark, d)
    return check.residual_histogram(gam(df, "quantity", season_terms(), family="gamma"), df)


@query()
def gam_kcheck(spark, d):
    return check.k_check(_fit_season(spark, d))


@query()
def gam_partial(spark, d):
    df = readings(spark, d)
    long = _fit_season(spark, d).partial_effects(df, ["date"])
    return long.groupBy("date", "term").agg(
        F.avg("effect").alias("effect"), F.avg("partial_residual").alias("partial_residual")
    )


@query()
def gam_residual_correlation(spark, d):
    df = daily(spark, d)
    model = gam(df, "quantity", season_terms(), family="gamma")
    return correlogram(model.residuals(df), "deviance", "date")
