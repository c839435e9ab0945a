import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnis.functions import stats
from tarnis.smooth import check, gam, linear, re, s, te, ti
from tarnis.smooth.bases import CubicBasis, ThinPlateBasis
from tarnis.smooth.family import Tweedie
from tarnis.smooth.fit import AR, yule_walker

DOY = {"DOY": (0, 366.5)}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.uniform(0, 1, n)
    doy = rng.integers(1, 366, n).astype(float)
    year = rng.integers(1990, 2010, n).astype(float)
    eta = 1 + np.sin(2 * np.pi * doy / 365) + np.cos(3 * x)
    mu = np.exp(eta)
    lam = mu**0.6 / 0.9  # compound Poisson with gamma jumps of shape 1.5 has power 1.4
    jumps = rng.poisson(lam)
    tw = np.where(jumps > 0, rng.gamma(1.5 * np.maximum(jumps, 1), mu / lam / 1.5), 0.0)
    pdf = pd.DataFrame(
        {
            "x": x, "DOY": doy, "year": year, "eta": eta, "gauss": eta + rng.normal(0, 0.5, n),
            "gamma": rng.gamma(4, mu / 4), "tw": tw, "id": np.arange(n),
            "site": np.where(rng.uniform(size=n) < 0.5, "a", "b"),
        }
    )
    return spark.createDataFrame(pdf).repartition(5).cache()


# --- scalar distributions ---


def test_distribution_functions():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert stats.t_quantile(0.975, 1e6) == pytest.approx(1.959963985, rel=1e-5)
    assert stats.chi2_tail(3.841458821, 1) == pytest.approx(0.05, rel=1e-7)
    assert stats.chi2_tail(20.0, 10) == pytest.approx(0.02925269, rel=1e-6)
    assert stats.f_tail(4.0, 2, 10) == pytest.approx(0.05288, rel=1e-3)
    x = np.array([0.1, 0.5, 1.0, 3.7, 20.0, 1e5])
    assert np.allclose(stats.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


# --- bases ---


def test_cubic_basis_reproduces_lines_and_curves():
    b = CubicBasis(np.array([0.0, 1.0, 2.5, 4.0, 5.0]))
    x = np.linspace(-2, 7, 60)
    assert np.allclose(b.design(x) @ (2 + 3 * b.knots), 2 + 3 * x)  # natural splines hold lines, also outside
    assert np.allclose(b.design(b.knots), np.eye(5), atol=1e-12)
    assert np.allclose(b.penalty @ b.knots, 0, atol=1e-10)
    # the penalty is the integral of the squared second derivative
    beta = np.array([0.0, 1.0, -1.0, 2.0, 0.5])
    u = np.linspace(0, 5, 200_001)
    f = b.design(u) @ beta
    second = np.diff(f, 2) / (u[1] - u[0]) ** 2
    assert beta @ b.penalty @ beta == pytest.approx(np.sum(second**2) * (u[1] - u[0]), rel=1e-3)


def test_cyclic_basis_closes():
    b = CubicBasis(np.linspace(0, 366.5, 12), cyclic=True)
    ends = b.design(np.array([0.0, 366.5, 10.0, 376.5]))
    assert np.allclose(ends[0], ends[1]) and np.allclose(ends[2], ends[3])
    eps = 1e-4
    d = b.design(np.array([0.0, eps, 366.5 - eps]))
    assert np.allclose((d[1] - d[0]) / eps, (d[0] - d[2]) / eps, atol=1e-3)
    assert np.allclose(b.penalty @ np.ones(11), 0, atol=1e-10)


def test_thin_plate_basis_spans_lines():
    b = ThinPlateBasis(np.linspace(3, 9, 50), 8)
    x = np.linspace(3, 9, 31)
    design = b.design(x)
    assert design.shape == (31, 8)
    fit, *_ = np.linalg.lstsq(design, 2 * x - 1, rcond=None)
    assert np.allclose(design @ fit, 2 * x - 1)
    values = np.linalg.eigvalsh(b.penalty)
    assert values.min() > -1e-9 and (values > 1e-9).sum() == 6


def test_tweedie_density_sums_to_one():
    for power, scale, mu in ((1.2, 0.8, 2.0), (1.5, 1.3, 1.0), (1.8, 0.5, 3.0)):
        f = Tweedie(power)
        kernel = lambda y: (y * mu ** (1 - power) / (1 - power) - mu ** (2 - power) / (2 - power)) / scale  # noqa: B023, E731
        zero = math.exp(float(kernel(0.0)))
        y = np.exp(np.linspace(math.log(1e-9), math.log(80 * mu), 40_001))
        dens = np.exp(f.log_base(y, scale) + kernel(y)) * y
        area = np.sum((dens[1:] + dens[:-1]) / 2 * np.diff(np.log(y)))
        assert zero + area == pytest.approx(1, abs=2e-4)


def test_tweedie_series_and_integral_agree():
    f = Tweedie(1.5)
    # continuity where the sum over indices gives way to its integral, at index 2000
    scale = 30.0**0.5 * 2 / 2000
    near = 30.0 ** np.array([1 - 1e-9, 1 + 1e-9])
    v = f.log_base(near, scale)
    assert abs(v[1] - v[0]) < 1e-3


# --- fits ---


@pytest.mark.parametrize("family,link,power", [("gamma", "log", None), ("tweedie", "log", 1.5)])
def test_no_penalty_equals_spark_glm(spark, data, family, link, power):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    y = "gamma" if family == "gamma" else "tw"
    model = gam(data, y, [linear("x"), linear("DOY")], family=family, power=power or 1.5, lam=0.0)
    rows = VectorAssembler(inputCols=["x", "DOY"], outputCol="f").transform(data)
    args = {"link": link} if family == "gamma" else {"variancePower": power, "linkPower": 0.0}
    glm = GeneralizedLinearRegression(family=family, featuresCol="f", labelCol=y, regParam=0.0, tol=1e-10, maxIter=50, **args).fit(rows)
    assert model.beta == pytest.approx([glm.intercept, *glm.coefficients], abs=1e-6)
    if family == "gamma":  # Spark moves zeros up before it takes the Tweedie deviance
        assert model.deviance == pytest.approx(glm.summary.deviance, rel=1e-6)
    else:
        rows_ = data.select("tw", "x", "DOY").toPandas()
        mu = np.exp(model.beta[0] + model.beta[1] * rows_.x + model.beta[2] * rows_.DOY)
        unit = 4 * (-2 * np.sqrt(rows_.tw) + rows_.tw / np.sqrt(mu) + np.sqrt(mu))
        assert model.deviance == pytest.approx(unit.sum(), rel=1e-9)
    assert model.scale == pytest.approx(glm.summary.dispersion, rel=1e-5)
    assert np.sqrt(np.diag(model.covariance))[1:] == pytest.approx(glm.summary.coefficientStandardErrors[:2], rel=1e-4)


def test_inverse_gaussian_equals_spark_glm(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    model = gam(data, "gamma", [linear("x")], family="inverse_gaussian", lam=0.0)
    rows = VectorAssembler(inputCols=["x"], outputCol="f").transform(data)
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=3.0, linkPower=0.0, featuresCol="f", labelCol="gamma", tol=1e-10, maxIter=100).fit(rows)
    assert model.beta == pytest.approx([glm.intercept, *glm.coefficients], abs=1e-5)


def test_huge_penalty_is_a_straight_line(spark, data):
    smooth = gam(data, "gauss", [s("x", bs="cr", k=10)], lam=1e12)
    line = gam(data, "gauss", [linear("x")])
    p = smooth.predict(data, se=False).withColumnRenamed("fit", "a")
    diff = line.predict(p, se=False).agg(F.max(F.abs(F.col("fit") - F.col("a")))).first()[0]
    assert diff < 1e-4
    assert smooth.edf == pytest.approx(2, abs=1e-3)


@pytest.mark.parametrize("bs", ["tp", "cr"])
def test_gamma_recovers_the_truth(spark, data, bs):
    m = gam(data, "gamma", [s("x", bs=bs), s("DOY", bs="cc", k=12, knots=DOY), s("year", bs=bs, k=8)], family="gamma")
    p = m.predict(data).agg(
        F.sqrt(F.avg(F.pow(F.col("fit") - F.col("eta"), 2))).alias("rmse"),
        F.avg(F.col("eta").between(F.col("lower"), F.col("upper")).cast("int")).alias("cover"),
    ).first()
    assert p.rmse < 0.06 and p.cover > 0.85
    assert m.scale == pytest.approx(0.25, abs=0.03)
    rows = {r.term: r for r in m.summary().collect()}
    assert rows["s(x)"].p < 1e-6 and rows["s(DOY)"].p < 1e-6 and rows["s(year)"].p > 1e-3
    stat = m.statistics().first()
    assert stat.n == 3000 and 0.5 < stat.deviance_explained < 0.9 and math.isfinite(stat.criterion)


def test_compression_changes_nothing(spark, data):
    whole = data.withColumn("x", F.round("x", 1))
    terms = [s("x", bs="cr", k=5), s("DOY", bs="cc", k=8, knots=DOY)]
    once = gam(whole, "gamma", terms, family="gamma")
    # five copies repeat every covariate combination, so cells are formed
    copies = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    many = gam(copies, "gamma", terms, family="gamma", lam=once.lam * 1.0)
    assert many.n == 5 * once.n
    assert many.deviance_explained == pytest.approx(once.deviance_explained, abs=5e-3)
    assert many.frame.cells.count() < many.n


def test_partitioning_changes_nothing(spark, data):
    from tarnis.smooth.family import Gamma
    from tarnis.smooth.fit import build_design, prepare, run_pass

    grams = []
    for parts in (1, 8):
        frame = prepare(data.repartition(parts), "gamma", ["x", "DOY"], Gamma(), set(), None)
        design = build_design(frame, [s("x"), s("DOY", bs="cc", k=12, knots=DOY)], False)
        grams.append(run_pass(frame, design, Gamma(), None).gram)
        frame.cells.unpersist()
    assert np.allclose(grams[0], grams[1], rtol=1e-9, atol=1e-9)


def test_many_tasks_are_summed_in_groups(spark):
    from tarnis.smooth.sums import sum_over_rows

    df = spark.range(0, 1000, 1, 100)
    partial = lambda pdf: np.array([len(pdf), pdf["id"].sum()], dtype=float)
    assert sum_over_rows(df, partial, 100).tolist() == [1000.0, 499500.0]
    assert sum_over_rows(df, partial, 2).tolist() == [1000.0, 499500.0]


def test_tweedie_with_select_and_power(spark, data):
    terms = [s("x"), s("DOY", bs="cc", k=12, knots=DOY), s("year", bs="cr", k=6)]
    fixed = gam(data, "tw", terms, family="tweedie", power=1.4, select=True)
    rows = {r.term: r for r in fixed.summary().collect()}
    assert rows["s(year)"].edf < 1.5 and rows["s(x)"].edf > 1.5
    rmse = fixed.predict(data).agg(F.sqrt(F.avg(F.pow(F.col("fit") - F.col("eta"), 2)))).first()[0]
    assert rmse < 0.12
    found = gam(data, "tw", [s("x", bs="cr", k=5), s("DOY", bs="cc", k=8, knots=DOY)], family="tweedie")
    assert found.family.variance_power == pytest.approx(1.4, abs=0.08)


def test_random_effect_shrinks_to_group_means(spark, data):
    shifted = data.withColumn("y", F.col("gauss") + F.when(F.col("site") == "a", 1.0).otherwise(-1.0))
    m = gam(shifted, "y", [s("DOY", bs="cc", k=8, knots=DOY), re("site")])
    out = {r.site: r.effect for r in m.predict_terms(shifted.select("DOY", "site"), "s(site)").groupBy("site").agg(F.avg("effect").alias("effect")).collect()}
    assert out["a"] - out["b"] == pytest.approx(2.0, abs=0.15)
    unseen = shifted.limit(1).withColumn("site", F.lit("new"))
    assert m.predict_terms(unseen, "s(site)").first().effect == 0.0


def test_scaled_t_resists_outliers(spark):
    rng = np.random.default_rng(2)
    x = np.linspace(0, 1, 600)
    y = np.sin(6 * x) + 0.1 * rng.standard_t(3, 600)
    y[::50] += 20
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "truth": np.sin(6 * x)}))
    m = gam(df, "y", [s("x", bs="cr", k=10)], family="scaled_t", nu=3.0)
    rmse = m.predict(df).agg(F.sqrt(F.avg(F.pow(F.col("fit") - F.col("truth"), 2)))).first()[0]
    assert rmse < 0.06


def test_missing_values(spark, data):
    holes = data.withColumn("x", F.when(F.col("id") % 10 != 0, F.col("x")))
    m = gam(holes, "gauss", [s("x", k=6)])
    assert m.n == 2700
    out = m.predict(holes)
    assert out.where("fit IS NULL").count() == 300 and out.where("x IS NULL AND fit IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="missing"):
        gam(holes, "gauss", [s("x", k=6)], na="fail")


def test_refusals(spark, data):
    with pytest.raises(ValueError, match="end knots"):
        s("DOY", bs="cc", k=12)
    with pytest.raises(ValueError, match="positive"):
        gam(data, "tw", [s("x")], family="gamma")
    with pytest.raises(ValueError, match="unknown family"):
        gam(data, "tw", [s("x")], family="poisson")
    m = gam(data, "gauss", [s("x", k=6)])
    with pytest.raises(ValueError, match="no term"):
        check.drop_terms(m, ["s(sqrt(x))"])
    other = gam(data, "sqrt(gamma)", [s("x", k=6)])
    with pytest.raises(ValueError, match="models sqrt"):
        check.compare({"a": m, "b": other})


# --- autoregressive errors ---


@pytest.fixture(scope="module")
def correlated(spark):
    rng = np.random.default_rng(3)
    rows = []
    for year in range(1990, 2000):
        e = 0.0
        for day in range(1, 366, 2):
            e = 0.6 * e + rng.normal(0, 0.32)
            rows.append((year, day, f"{year}-{day:03d}", 1 + math.sin(2 * math.pi * day / 365) + e))
    df = spark.createDataFrame(rows, "year int, DOY int, at string, log_y double")
    return df.withColumn("y", F.exp("log_y")).repartition(6).cache()


def test_yule_walker():
    assert yule_walker(np.array([10.0, 6.0, 3.6]), np.array([10.0, 10.0, 10.0])) == pytest.approx([0.6, 0.0], abs=1e-12)


@pytest.mark.parametrize("response,family", [("log_y", "gaussian"), ("y", "gamma")])
def test_ar1_is_recovered(spark, correlated, response, family):
    terms = [s("DOY", bs="cc", k=12, knots=DOY)]
    plain = gam(correlated, response, terms, family=family, ar=AR(0, "year", ["at"]))
    first = gam(correlated, response, terms, family=family, ar=AR(1, "year", ["at"]))
    second = gam(correlated, response, terms, family=family, ar=AR(2, "year", ["at"], bounded=True))
    assert first.phi[0] == pytest.approx(0.6, abs=0.06)
    assert abs(second.phi[1]) < 0.07
    assert first.aic < plain.aic - 100 and second.aic > first.aic - 4
    test = check.lrt(plain, first).first()
    assert test.df == 1 and test.p < 1e-10
    # ignoring the correlation makes the intervals too narrow
    wide = first.covariance[0, 0] / plain.covariance[0, 0]
    assert wide > 2


# --- reports ---


@pytest.fixture(scope="module")
def season_model(spark, data):
    return gam(data, "gamma", [s("DOY", bs="cc", k=12, knots=DOY), s("year", bs="cr", k=8), ti("DOY", "year", bs=("cc", "cr"), knots=DOY)], family="gamma")


def test_terms_add_up(spark, data, season_model):
    m = season_model
    rows = data.select("id", "DOY", "year")
    total = None
    for t in ("s(DOY)", "s(year)", "ti(DOY,year)"):
        part = m.predict_terms(rows, t).select("id", "effect", "constant")
        total = part if total is None else total.unionAll(part)
    summed = total.groupBy("id").agg((F.sum("effect") + F.first("constant")).alias("sum"))
    worst = m.predict(rows).join(summed, "id").agg(F.max(F.abs(F.col("fit") - F.col("sum")))).first()[0]
    assert worst < 1e-8


def test_derivative_matches_differences(spark, season_model):
    d = season_model.smooth_derivative("s(DOY)", n=50).orderBy("DOY").toPandas()
    near = spark.createDataFrame([(float(x) + h, 2000.0) for x in d.DOY for h in (-0.01, 0.01)], "DOY double, year double")
    e = season_model.predict_terms(near, "s(DOY)").orderBy("DOY").toPandas().effect.to_numpy()
    assert np.allclose((e[1::2] - e[::2]) / 0.02, d.derivative, atol=1e-5)
    assert (d.lower_ci < d.derivative).all() and (d.upper_ci > d.derivative).all()


def test_change_and_curves(spark, season_model):
    c = season_model.change("s(DOY)").toPandas()
    assert len(c) == 200 and set(c.sig) == {1, 2}
    curves = season_model.seasonal_curves(years=(1990, 1992)).toPandas()
    assert len(curves) == 3 * 365 and (curves.lower < curves.fit).all() and (curves.fit < curves.upper).all()


def test_surface_is_masked(spark, data):
    sparse = data.where("year < 1995 OR year > 2005")
    m = gam(sparse, "gamma", [te("year", "DOY", bs=("cr", "cc"), k=(5, 6), knots=DOY)], family="gamma")
    surface = m.response_surface("te(year,DOY)", n=25).toPandas()
    assert len(surface) == 625
    assert surface.too_far.any() and surface.value.isna().equals(surface.too_far)


def test_observed_and_predicted(spark, data, season_model):
    long = season_model.observed_vs_predicted(data, ["id"])
    assert long.count() == 6000
    assert {r.fit for r in long.select("fit").distinct().collect()} == {"Observed", "Predicted"}


def test_diagnostics(spark, data, season_model):
    rows = check.diagnostics(season_model, data).toPandas()
    assert len(rows) == 3000
    assert np.sum(rows.deviance**2) == pytest.approx(season_model.deviance, rel=1e-6)
    assert np.allclose(rows.pearson, (rows.observed - rows.fitted) / rows.fitted)
    qq = check.qq_points(season_model, data, ["id"]).orderBy("rank").toPandas()
    assert qq["sample"].is_monotonic_increasing and qq.theoretical.is_monotonic_increasing and len(qq) == 3000
    assert check.residual_histogram(season_model, data).agg(F.sum("n")).first()[0] == 3000
    effects = season_model.partial_effects(data, ["id"])
    assert effects.count() == 9000


def test_basis_check_finds_a_small_basis(spark, data):
    small = gam(data, "gauss", [s("DOY", bs="cr", k=3), s("x", k=10)])
    rows = {r.term: r for r in check.k_check(small).collect()}
    assert rows["s(DOY)"].p < 0.01 and rows["s(DOY)"].k_index < rows["s(x)"].k_index
    big = gam(data, "gauss", [s("DOY", bs="cc", k=12, knots=DOY), s("x", k=10)])
    assert {r.term: r.p for r in check.k_check(big, data).collect()}["s(DOY)"] > 0.01


def test_dropping_terms(spark, data):
    full = gam(data, "gauss", [s("x"), s("DOY", bs="cc", k=12, knots=DOY), s("year", bs="cr", k=6)])
    dropped = check.drop_terms(full, ["s(x)", "s(year)"])
    again = gam(data, "gauss", [s("x"), s("DOY", bs="cc", k=12, knots=DOY)])
    assert dropped["s(year)"].aic == pytest.approx(again.aic, abs=0.05)
    assert dropped["s(x)"].aic > full.aic + 100
    table = check.compare({"full": full, **dropped}, "BIC").toPandas()
    assert list(table.columns) == ["model", "df", "BIC"]
    p = check.lrt(dropped["s(x)"], full).first()
    assert p.df > 1 and p.p < 1e-10


def test_ml_and_reml_agree_roughly(spark, data):
    a = gam(data, "gauss", [s("x", bs="cr")], method="REML")
    b = gam(data, "gauss", [s("x", bs="cr")], method="ML")
    assert abs(a.edf - b.edf) < 1.0


def test_variables_may_be_expressions(spark, data):
    m = gam(data, "sqrt(gamma)", [s("sqrt(x)", k=6)])
    assert m.summary().first().term == "s(sqrt(x))"
    assert m.change("s(sqrt(x))", n=20).count() == 20


def test_reports(spark, correlated, data):
    from tarnis.plans.predictors import compare_candidates, predictor_report
    from tarnis.plans.season import season_report

    report = season_report(correlated, "y", ["at"], max_ar=1, k_year=5, surface=15)
    assert report["orders"].count() == 2
    assert report["autocorrelation"].count() == 37
    assert report["surface"].count() == 225
    assert report["year_change"].count() == 200 and report["year_periods"].columns[:2] == ["start", "end"]
    terms = [s("x", k=5), s("DOY", bs="cc", k=8, knots=DOY)]
    out = predictor_report(data, ["id"], "tw", terms, ["s(x)"], power=1.4)
    assert out["dropped"].count() == 2 and out["temporal_ranges"].count() == 1
    table = compare_candidates(data, "gauss", {"one": terms[:1], "two": terms}, family="gaussian", select=False)
    values = {r.model: r.AIC for r in table.collect()}
    assert values["two"] < values["one"]


@pytest.mark.parametrize("method", ["REML", "ML"])
def test_smoothing_parameters_minimise_the_score(spark, data, method):
    """No nearby choice of smoothing parameters has a better score than the one found."""
    terms = [s("x", bs="cr"), te("year", "DOY", bs=("cr", "cc"), k=(4, 6), knots=DOY)]
    m = gam(data, "gauss", terms, method=method)
    for j in range(len(m.lam)):
        for factor in (0.7, 1.4):
            lam = m.lam.copy()
            lam[j] *= factor
            assert gam(data, "gauss", terms, method=method, lam=lam).working_score > m.working_score - 2e-3


def test_basis_index_equals_neighbour_differences(spark):
    """Without ties the index is the sum of squared neighbour differences over twice the variance."""
    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(size=400))
    y = np.sin(9 * x) + 0.2 * rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(4)
    m = gam(df, "y", [s("x", bs="cr", k=4)])
    e = check.diagnostics(m, df).select("x", "deviance").toPandas().sort_values("x").deviance.to_numpy()
    want = np.mean(np.diff(e) ** 2) / 2 / np.var(e, ddof=1)
    assert check.k_check(m).first().k_index == pytest.approx(want, rel=1e-9)


def test_basis_index_with_ties_is_the_mean_over_orders(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, 60).astype(float)
    y = x + rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    m = gam(df, "y", [s("x", bs="cr", k=3)])
    r = check.diagnostics(m, df).select("x", "deviance").toPandas()
    total = 0.0
    for _ in range(4000):
        e = r.sample(frac=1, random_state=rng.integers(1 << 31)).sort_values("x", kind="stable").deviance.to_numpy()
        total += np.mean(np.diff(e) ** 2) / 2 / np.var(e, ddof=1)
    assert check.k_check(m).first().k_index == pytest.approx(total / 4000, rel=0.01)
