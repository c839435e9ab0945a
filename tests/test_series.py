import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnis.operators import order, quantiles, series, summary
from tarnis.operators.regression import ols


def reference_acf(x, lags):
    y = np.asarray(x) - np.mean(x)
    return [float(np.dot(y[: len(y) - k], y[k:]) / np.dot(y, y)) if k < len(y) else None for k in range(lags + 1)]


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    x = np.zeros(n)
    for i in range(n):
        x[i] = (0.7 * x[i - 1] if i else 0) + e[i]
    return 1000 + x


@pytest.mark.parametrize("parts", [1, 8])
def test_acf_of_one_long_series_in_pieces(spark, parts):
    x = sample(3000)
    rows = list(enumerate(x.tolist()))
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "t long, x double").repartition(parts)
    got = {r.lag: r for r in series.correlogram(df, "x", "t").collect()}
    want = reference_acf(x, 36)
    assert max(abs(got[k].acf - want[k]) for k in range(37)) < 1e-10
    assert got[0].acf == 1.0 and got[0].pacf is None
    # partial autocorrelation by solving the Yule-Walker equations of each order
    for k in (1, 2, 5):
        m = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(got[k].pacf - np.linalg.solve(m, want[1 : k + 1])[-1]) < 1e-9


def test_acf_of_several_series(spark):
    rows, want = [], {}
    for name, n in (("a", 700), ("b", 20), ("c", 2000), ("constant", 50), ("single", 1)):
        x = np.full(n, 3.3) if name == "constant" else sample(n, len(name) + n)
        want[name] = x
        rows += [(name, i, float(v)) for i, v in enumerate(x)]
    rows.append(("a", 10_000, None))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "s string, t long, x double").repartition(5)
    got = {(r.s, r.lag): r.acf for r in series.acf(df, "x", ["t"], by=["s"]).collect()}
    assert len(got) == 5 * 37
    for name in ("a", "b", "c"):
        ref = reference_acf(want[name], 36)
        for k in range(37):
            if ref[k] is None:
                assert got[(name, k)] is None
            else:
                assert abs(got[(name, k)] - ref[k]) < 1e-9, (name, k)
    assert got[("constant", 0)] is None and got[("single", 0)] is None


def test_row_index_is_the_sorted_position(spark):
    values = [random.Random(2).random() for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    got = order.with_row_index(df, ["v"]).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(5000))
    assert [r.v for r in got] == sorted(values)


@pytest.mark.parametrize("block", [3, 64, 100_000])
def test_blocked_windows_equal_plain_windows(spark, block):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randint(0, 30)}", i, rng.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "s string, t long, x double").repartition(6)
    columns = {
        "m": lambda w: F.avg("x").over(w.rowsBetween(-3, 2)),
        "back": lambda w: F.lag("x", 3).over(w),
        "ahead": lambda w: F.lead("x", 2).over(w),
    }
    a = order.over_neighbours(df, columns, ["t"], ["s"], 3, 2, block_rows=block)
    b = order.over_neighbours(df, columns, ["t"], ["s"], 3, 2, bounded=True)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


@pytest.mark.parametrize("span", [4096, 3])
def test_running_total_of_one_series(spark, monkeypatch, span):
    monkeypatch.setattr(order, "SPAN", span)
    df = spark.createDataFrame([(i, i * i % 11) for i in range(900)], "i long, x long").repartition(4)
    got = {r.i: r.total for r in order.with_running_total(df, F.col("x"), "i", block_rows=25).collect()}
    assert [got[i] for i in range(900)] == np.cumsum([i * i % 11 for i in range(900)]).tolist()


def test_running_total_across_blocks(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string, t long, x long").repartition(4)
    numbered = order.with_row_index(df, ["s", "t"], "i")
    out = order.with_running_total(numbered, F.col("x"), "i", ["s"], block_rows=37)
    got = {(r.s, r.t): r.total for r in out.collect()}
    total = {}
    for s, t, x in rows:
        total[s] = total.get(s, 0) + x
        assert got[(s, t)] == total[s]


def test_moving_average_needs_a_full_window(spark):
    df = spark.createDataFrame([(i, None if i == 4 else float(i)) for i in range(8)], "t int, x double")
    for bounded in (True, False):
        got = {r.t: r.x_mean3 for r in series.centered_mean(df, "x", "t", bounded=bounded).collect()}
        assert got == {0: None, 1: 1.0, 2: 2.0, 3: None, 4: None, 5: None, 6: 6.0, 7: None}
    with pytest.raises(ValueError, match="odd"):
        series.centered_mean(df, "x", "t", k=4)


@pytest.mark.parametrize("bounded", [True, False])
def test_change_periods(spark, bounded):
    flags = "TTFFTTTNFT"
    rows = [("s", i, {"T": True, "F": False, "N": None}[f]) for i, f in enumerate(flags)] + [("u", i, True) for i in range(4)]
    df = spark.createDataFrame(rows, "s string, t int, f boolean").repartition(4)
    got = sorted(tuple(r) for r in series.change_periods(df, "t", "f", ["s"], bounded=bounded).collect())
    assert got == [("s", 0, 1, 2), ("s", 4, 6, 3), ("s", 9, 9, 1), ("u", 0, 3, 4)]


def test_significant_change_codes(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (0.5, 1.0), (-2.0, -1.0), (0.0, 1.0), (None, 1.0)], "lower double, upper double")
    got = [(r.Null_test, r.sig) for r in series.significant_change(df).collect()]
    assert got == [(True, 2), (False, 1), (False, 1), (True, 2), (None, None)]


def test_whitening_leaves_no_correlation(spark):
    rng = np.random.default_rng(5)
    rows = []
    for year in range(2000, 2006):
        r = [0.0, 0.0]
        for i in range(400):
            r.append(0.5 * r[-1] - 0.3 * r[-2] + rng.normal())
            rows.append((year, i, float(r[-1])))
    df = spark.createDataFrame(rows, "year int, t int, r double")
    out = series.ar_residuals(df, "r", "t", ["year"], [0.5, -0.3])
    acf = {r.lag: r.acf for r in series.acf(out, "normalized", ["year", "t"], max_lag=3).collect()}
    assert all(abs(acf[k]) < 0.06 for k in (1, 2, 3))
    with pytest.raises(ValueError, match="stationary"):
        series.innovations([1.2])


@pytest.mark.parametrize("by", [[], ["s"]])
def test_exact_quantiles_of_awkward_values(spark, by):
    rng = random.Random(6)
    rows = []
    for s in ("ties", "tails", "few", "normal"):
        n = 3 if s == "few" else 2000
        for _ in range(n):
            x = {"ties": float(rng.randint(0, 3)), "tails": rng.paretovariate(0.3), "few": rng.random(), "normal": rng.gauss(-5, 2)}[s]
            rows.append((s, x))
    rows += [("ties", None), ("ties", float("nan")), ("empty", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "s string, x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.975, 1.0]
    got = quantiles.quantiles(df, "x", probs, by).collect()
    if not by:
        values = np.array([x for _, x in rows if x is not None and x == x])
        assert np.allclose(list(got[0]), np.quantile(values, probs), rtol=1e-12, atol=0)
        return
    assert {r.s for r in got} == {"ties", "tails", "few", "normal", None}
    for r in got:
        values = np.array([x for s, x in rows if s == r.s and x is not None and x == x])
        assert np.allclose(list(r[1:]), np.quantile(values, probs), rtol=1e-12, atol=0), r.s


def test_summary_counts_rows_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("c", 2.0)], "p string, x double")
    got = {r.p: r for r in summary.summary6(df, "x", ["p"]).collect()}
    assert (got["a"]["mean"], got["a"]["median"], got["a"]["count"]) == (2.0, 2.0, 3)
    assert got["b"]["mean"] is None and got["b"]["median"] is None and got["b"]["count"] == 1
    assert got["c"]["sd"] is None and got["c"]["max"] == 2.0


def test_annual_median_date(spark):
    rows = [(dt.date(2000, 1, 1), 1.0), (dt.date(2000, 1, 2), 5.0), (dt.date(2000, 1, 5), None), (dt.date(2000, 12, 1), 2.0)]
    df = spark.createDataFrame(rows, "d date, x double")
    r = summary.annual_extreme(df, "x", "d").first()
    assert (r["year"], r["max"], str(r["median_date"])) == (2000, 5.0, "2000-01-03 12:00:00")


def test_histogram_edges_and_total(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(1000)] + [(None,)], "x double")
    rows = summary.histogram(df, ["x"]).orderBy("bin").collect()
    assert sum(r.n for r in rows) == 1000 and len(rows) == 30
    assert rows[0].left < 0 <= rows[0].right and rows[-1].left < 49 <= rows[-1].right
    constant = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert [r.n for r in summary.histogram(constant, ["x"]).collect()] == [5]


def test_density_integrates_to_about_one(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", rng.gauss(4, 0.5)) for _ in range(50)], "g string, x double")
    rows = summary.density(df, "x", ["g"], n=256).collect()
    step = sorted(r.x for r in rows if r.g == "a")
    step = step[1] - step[0]
    for g in "ab":
        assert abs(sum(r.density for r in rows if r.g == g) * step - 1) < 0.03


def test_correlation_uses_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 1.0), (2.0, 4.0, 1.0, 1.0), (3.0, 6.5, 5.0, 1.0), (4.0, None, 2.0, 1.0)], "a double, b double, c double, k double")
    got = {(r.x, r.y): r["corr"] for r in summary.corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert abs(got[("a", "b")] - np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) < 1e-12
    assert abs(got[("a", "c")] - np.corrcoef([2, 3, 4], [1, 5, 2])[0, 1]) < 1e-12
    assert got[("a", "k")] is None


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 2)) + [1000, 0]
    y = 3 + x @ [0.5, -2] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    fit = ols(df, "y", ["a", "b"])
    design = np.column_stack([np.ones(200), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 197)
    assert np.allclose(fit.coef, beta, rtol=1e-6) and np.allclose(fit.se, se, rtol=1e-6)
    r = fit.summary().first()
    assert r.n == 200 and abs(r.r2 - (1 - rss[0] / np.sum((y - y.mean()) ** 2))) < 1e-9
    assert fit.residual_summary().first()["min"] == pytest.approx(np.min(y - design @ beta), rel=1e-6)
