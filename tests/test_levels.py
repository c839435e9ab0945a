"""Quantiles by digits, knots by one rule, and random effects kept as tables of levels."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnis.operators import quantiles
from tarnis.smooth import fit, gam, linear, re, s
from tarnis.smooth.terms import covariate_points


def test_order_keys_keep_order_and_value(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    values = [struct.unpack("d", struct.pack("Q", int(b)))[0] for b in bits]
    values += [0.0, -0.0, 5e-324, -5e-324, 1e-310, float("inf"), -float("inf"), *[2.0**e for e in range(-1074, 1024, 7)]]
    values += [float(np.nextafter(2.0**e, 0)) for e in range(-1060, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values if v == v], "x double").withColumn("k", quantiles.order_key(F.col("x")))
    rows = sorted(df.withColumn("back", quantiles.order_value(F.col("k"))).collect(), key=lambda r: r.x)
    assert all(r.x == r.back for r in rows)
    assert all((a.x < b.x) == (a.k < b.k) for a, b in zip(rows, rows[1:]))


def test_quantiles_of_values_that_share_their_leading_digits(spark):
    """Nearly all values lie within a billionth of each other, beside one far away."""
    rng = np.random.default_rng(2)
    values = np.append(1 + rng.uniform(0, 1e-9, 20_000), 1e12)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(7)
    probs = [0, 0.1, 0.5, 0.999, 1]
    assert list(quantiles.quantiles(df, "x", probs).first()) == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-15)
    tied = df.withColumn("n", F.when(F.col("x") < 2, 3).otherwise(10_000).cast("long"))
    want = np.quantile(np.append(np.repeat(values[:-1], 3), np.repeat(1e12, 10_000)), [0.5, 0.95])
    assert list(quantiles.quantiles(tied, "x", [0.5, 0.95], weight="n").first()) == pytest.approx(want.tolist(), rel=1e-15)


def test_knots_do_not_depend_on_size_or_partitions(spark):
    rng = np.random.default_rng(3)
    x, z = rng.gamma(2, 3, 30_000), rng.integers(1, 366, 30_000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x0": x, "x1": z}))
    wanted = [("x0", "cr", 9, None), ("x1", "cc", 12, (0, 366.5)), ("x0", "tp", 10, None)]
    for parts in (1, 8):
        cubic, cyclic, centres = covariate_points(df.repartition(parts), wanted)
        assert cubic == pytest.approx(np.quantile(np.unique(x), np.linspace(0, 1, 9)), rel=1e-14)
        assert cyclic == pytest.approx(np.quantile(np.unique(np.append(z, [0, 366.5])), np.linspace(0, 1, 12)), rel=1e-14)
        assert centres == pytest.approx(np.quantile(np.unique(x), np.linspace(0, 1, 200)), rel=1e-14)
    with pytest.raises(ValueError, match="3 distinct values, 5"):
        covariate_points(df.withColumn("x0", F.col("x1") % 3), [("x0", "cr", 5, None)])


@pytest.fixture(scope="module")
def grouped(spark):
    """Unbalanced levels; one of them holds a third of the rows."""
    rng = np.random.default_rng(4)
    level = np.where(rng.uniform(size=900) < 1 / 3, 0, rng.integers(0, 30, 900))
    x, b = rng.uniform(0, 1, 900), rng.normal(0, 0.7, 30)
    y = np.sin(5 * x) + b[level] + rng.normal(0, 0.8, 900)
    pdf = pd.DataFrame({"x": x, "g": [f"k{i}" for i in level], "y": y, "mu": np.exp(0.4 * y) * rng.gamma(6, 1 / 6, 900)})
    return spark.createDataFrame(pdf).repartition(4).cache()


@pytest.mark.parametrize("family, response", [("gaussian", "y"), ("gamma", "mu")])
def test_levels_as_table_and_as_columns_agree(grouped, monkeypatch, family, response):
    terms = [s("x", bs="cr", k=6), re("g")]
    table = gam(grouped, response, terms, family=family)
    monkeypatch.setattr(fit, "_level_term", lambda frame, terms: None)
    columns = gam(grouped, response, terms, family=family)
    assert table.level is not None and columns.level is None
    for name in ("edf", "scale", "criterion", "loglik", "deviance", "null_deviance", "aic"):
        assert getattr(table, name) == pytest.approx(getattr(columns, name), rel=2e-6), name
    shown = [m.predict(grouped).orderBy("y").select("fit", "se").toPandas().to_numpy() for m in (table, columns)]
    assert np.allclose(shown[0], shown[1], rtol=1e-4, atol=1e-5)
    levels = grouped.groupBy("g").agg(F.lit(0.5).alias("x"))
    effects = [m.predict_terms(levels, "s(g)").orderBy("g").select("effect", "effect_se").toPandas().to_numpy() for m in (table, columns)]
    assert np.allclose(effects[0], effects[1], rtol=1e-4, atol=1e-5)


def test_levels_in_reports(grouped):
    model = gam(grouped, "y", [s("x", bs="cr", k=6), re("g")])
    rows = model.summary().collect()
    assert [r.term for r in rows] == ["s(x)", "s(g)"] and rows[1].max_df == 30 and 20 < rows[1].edf < 30 and rows[1].p < 1e-6
    parts = {r.term: r.n for r in model.partial_effects(grouped, ["x"]).groupBy("term").agg(F.count("effect").alias("n")).collect()}
    assert parts == {"s(x)": 900, "s(g)": 900}
    strange = model.predict(grouped.limit(5).withColumn("g", F.lit("never seen"))).collect()
    base = model.predict_terms(grouped.limit(5), "s(x)").collect()
    assert sorted(r.fit for r in strange) == pytest.approx(sorted(r.effect + r.constant for r in base))
    assert model.predict(grouped.limit(5).withColumn("g", F.lit(None).cast("string"))).where("fit IS NULL").count() == 5
    told = model.statistics().first()
    assert told["converged"] and told["gradient"] < 1e-6


def test_many_levels(spark):
    """Ten thousand levels: no matrix of levels, the estimate is that of the mean squares."""
    rng = np.random.default_rng(5)
    count, each = 10_000, 3
    b = rng.normal(0, 2, count)
    y = 5 + b[:, None] + rng.normal(0, 1, (count, each))
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat(np.arange(count), each).astype(str), "y": y.ravel()})).repartition(6)
    model = gam(df, "y", [re("g")])
    within, between = y.var(1, ddof=1).mean(), each * y.mean(1).var(ddof=1)
    assert model.scale == pytest.approx(within, rel=1e-8)
    assert model.scale / model.level.ratio == pytest.approx((between - within) / each, rel=1e-6)
    assert model.level.count == count and model.design.size == 1


def test_no_variance_between_levels(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"g": [str(i % 5) for i in range(300)], "x": rng.uniform(size=300), "y": np.tile(np.repeat([1.0, 2.0, 3.0], 5), 20)}))
    model = gam(df, "y", [linear("x"), re("g")])
    assert model.level.edf < 1e-3 and model.edf == pytest.approx(2, abs=1e-3)


def test_predictions_join_and_group_nothing(grouped):
    model = gam(grouped, "y", [s("x", bs="cr", k=6)])
    plan = model.predict(grouped)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "ArrowEvalPython" in plan
