"""Parameters of a response family, found over passes that try many values at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnis.smooth import gam, linear, te
from tarnis.smooth.check import curve_place, k_check
from tarnis.smooth.fit import search


def test_search_finds_a_maximum_and_an_edge():
    calls = []

    def hill(x):
        calls.append(len(x))
        return -np.cosh(3 * (x - 1.2345678))

    assert search(hill, 1.01, 1.99) == pytest.approx(1.2345678, abs=1e-6) and len(calls) < 8
    assert search(lambda x: x, 1.01, 1.99) == 1.99 and search(lambda x: -x, 1.01, 1.99) == 1.01


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x = rng.uniform(0, 1, n).round(2)
    mu = np.exp(0.5 + x)
    lam = mu**0.6 / 0.9  # compound Poisson with gamma jumps of shape 1.5 has power 1.4
    jumps = rng.poisson(lam)
    tweedie = np.where(jumps > 0, rng.gamma(1.5 * np.maximum(jumps, 1), mu / lam / 1.5), 0.0)
    heavy = 1 + 2 * x + 0.5 * rng.standard_t(4.7, n)
    return spark.createDataFrame(pd.DataFrame({"x": x, "tweedie": tweedie, "heavy": heavy})).repartition(3).cache()


def test_power_maximises_the_likelihood(simulated):
    model = gam(simulated, "tweedie", [linear("x")], family="tweedie")
    power = model.family.variance_power
    assert power == pytest.approx(1.4, abs=0.05) and model.converged
    around = [gam(simulated, "tweedie", [linear("x")], family="tweedie", power=p).loglik for p in (power - 0.004, power + 0.004)]
    assert model.loglik > max(around)
    # the vertex of the parabola through the three lies at the power found
    low, high = (model.loglik - a for a in around)
    assert abs(0.5 * 0.004 * (low - high) / (low + high)) < 2e-4


def test_degrees_of_freedom_are_recovered(simulated):
    model = gam(simulated, "heavy", [linear("x")], family="scaled_t")
    nu = model.family.nu
    assert nu == pytest.approx(4.7, rel=0.15) and model.family.sigma == pytest.approx(0.5, rel=0.05) and model.converged
    around = [gam(simulated, "heavy", [linear("x")], family="scaled_t", nu=nu * f).loglik for f in (0.97, 1 / 0.97)]
    assert model.loglik > max(around)


def test_curve_visits_every_cell_by_single_steps(spark):
    side = 16
    rows = spark.createDataFrame([(x << 11, y << 11) for x in range(side) for y in range(side)], "x long, y long")
    places = [(r.x >> 11, r.y >> 11) for r in rows.orderBy(curve_place([F.col("x"), F.col("y")])).collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(places, places[1:]))
    assert places[0] == (0, 0) and places[-1] == (side - 1, 0)
    three = spark.createDataFrame([(x << 14, y << 14, z << 14) for x in (0, 1) for y in (0, 1) for z in (0, 1)], "x long, y long, z long")
    assert three.select(curve_place([F.col("x"), F.col("y"), F.col("z")]).alias("d")).distinct().count() == 8


def test_fine_structure_of_two_variables_is_seen(spark):
    """Waves of a fiftieth of the range are far too fine for the basis, and for any coarse grid."""
    rng = np.random.default_rng(9)
    x, z = rng.uniform(size=(2, 20_000))
    pdf = pd.DataFrame({"x": x, "z": z, "waves": np.sin(100 * np.pi * x) + 0.3 * rng.normal(size=20_000), "noise": rng.normal(size=20_000)})
    df = spark.createDataFrame(pdf).repartition(4)
    seen = {y: k_check(gam(df, y, [te("x", "z", k=4)])).first() for y in ("waves", "noise")}
    assert seen["waves"].k_index < 0.9 and seen["waves"].p < 1e-9
    assert abs(seen["noise"].k_index - 1) < 0.03 and seen["noise"].p > 1e-3
