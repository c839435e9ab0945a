import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarnis.functions import columns as c
from tarnis.operators import filters, frame, joins, reshape


def one(df):
    return [tuple(r) for r in df.collect()]


def test_dates_in_both_layouts_and_rubbish(spark):
    df = spark.createDataFrame([("1/2/1990",), ("01/02/1990",), ("1990-01-02",), ("oops",), (None,)], "d string")
    got = [r[0] for r in df.select(c.parse_date("d")).collect()]
    assert got == [dt.date(1990, 1, 2)] * 3 + [None, None]


def test_typed_dates_pass_through(spark):
    df = spark.sql("SELECT DATE '2001-03-04' AS d")
    assert df.select(c.parse_date("d")).first()[0] == dt.date(2001, 3, 4)


def test_serial_dates(spark):
    df = spark.createDataFrame([("36892",), ("36892.75",), ("x",)], "s string")
    assert [r[0] for r in df.select(c.serial_to_date("s")).collect()] == [dt.date(2001, 1, 1)] * 2 + [None]


def test_week_is_monday_first_and_starts_at_zero(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    for r in frame.with_calendar(df).collect():
        assert r.week == int(r.date.strftime("%W"))
        assert r.DOY == r.date.timetuple().tm_yday


def test_month_shift_clamps_to_month_end(spark):
    df = spark.sql("SELECT DATE '2000-08-31' AS d")
    assert df.select(c.shift_months("d", -6)).first()[0] == dt.date(2000, 2, 29)


def test_impossible_month_is_null(spark):
    df = spark.createDataFrame([(2000, 2), (2000, 13), (None, 1)], "y int, m int")
    assert [r[0] for r in df.select(c.date_of("y", "m")).collect()] == [dt.date(2000, 2, 1), None, None]


def test_decimal_year(spark):
    df = spark.createDataFrame([(1992.0205,), (1997.75,), (2000.0,)], "y double")
    got = [r[0] for r in df.select(c.day_month_year(c.decimal_year_to_date("y"))).collect()]
    assert got == ["08-01-1992", "01-10-1997", "01-01-2000"]


def test_row_sum_of_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0)], "a double, b double")
    out = df.select(c.row_sum(["a", "b"]), c.row_sum(["a", "b"], True), c.strict_sum(["a", "b"]))
    assert one(out) == [(1.0, 1.0, None), (0.0, None, None), (5.0, 5.0, 5.0)]


def test_detection_limits(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (None, 1.0, 2.0)], "NO3 double, NH3 double, SRP double")
    assert one(frame.half_detection_limit(df)) == [(0.0285, 0.043, 1.5), (None, 1.0, 2.0)]


def test_phase_labels(spark):
    rows = [(-1.0, 1.0), (1.0, -1.0), (0.0, 1.0), (None, 1.0), (-1.0, None)]
    out = frame.with_phase(spark.createDataFrame(rows, "PDO double, SOI double"))
    got = [(r.PDO_desc, r.SOI_desc, r.Desc) for r in out.collect()]
    assert got == [
        ("Wet", "Cool_Wet", "Cool_wet"),
        ("Dry", "Warm_Dry", "Warm_dry"),
        ("Dry", "Cool_Wet", "Other"),
        (None, "Cool_Wet", "Other"),
        ("Wet", None, "Other"),
    ]


def test_percent_of_zero_total_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 4.0), (1.0, 1.0, 0.0), (None, 1.0, 4.0)], "a double, b double, t double")
    assert [r.p for r in frame.percent_of(df, ["a", "b"], "t", "p").collect()] == [50.0, None, None]


def test_numeric_cols_touches_text_only(spark):
    df = spark.createDataFrame([("1.5", 2, "oops")], "a string, b int, `c.d` string")
    out = frame.numeric_cols(df)
    assert [tuple(r) for r in out.collect()] == [(1.5, 2, None)]
    assert dict(out.dtypes)["b"] == "int"


def test_rename_of_missing_column_raises(spark):
    with pytest.raises(ValueError, match="nope"):
        frame.rename(spark.range(1), {"nope": "x"})


def test_strip_prefix_clash_raises(spark):
    df = spark.sql("SELECT 1 AS tbl_a, 2 AS a")
    with pytest.raises(ValueError, match="clash"):
        frame.strip_prefix(df, "tbl_")


def test_strip_leading_dot(spark):
    df = spark.createDataFrame([(1, 2)], ["`.x`".strip("`"), "y"])
    assert frame.strip_prefix(df, r"\.").columns == ["x", "y"]


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.024, 0.3, 0.5, 0.8, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", c.normal_quantile("p").alias("q"))
    for r in df.collect():
        assert math.isclose(r.q, NormalDist().inv_cdf(r.p), abs_tol=1e-7)


def test_null_conditions_drop_rows(spark):
    df = spark.createDataFrame([(2000, 0.0), (2001, 1.0), (None, 2.0), (2002, None)], "year int, x double")
    assert [r.year for r in filters.exclude_year(df, 2001).collect()] == [2000, 2002]
    assert [r.x for r in filters.nonzero(df, ["x"]).collect()] == [1.0, 2.0]


def test_complete_cases_drops_nan_and_dotted_names(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "`Chla_ug.L` double")
    assert filters.complete_cases(df, ["Chla_ug.L"]).count() == 1


def test_max_nulls_edges(spark):
    df = spark.createDataFrame([(1, None, None), (1, 2, None), (None, None, None)], "a int, b int, c int")
    assert filters.max_nulls(df, 2).count() == 2
    assert filters.max_nulls(df, 1, ["a", "b"]).count() == 2


def test_year_range_reaches_the_scan(spark, sf):
    df = filters.in_years(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_shipdate", 1996, 1997)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed


def test_strict_mean_in_wide_table(spark):
    rows = [("d", "A", 1.0), ("d", "A", 3.0), ("d", "B", 1.0), ("d", "B", None), ("e", "A", 2.0), ("e", "Z", 9.0)]
    df = spark.createDataFrame(rows, "date string, p string, x double")
    out = reshape.to_wide(df, ["date"], "p", "x", {"A": "a", "B": "b"}).orderBy("date")
    assert one(out) == [("d", 2.0, None), ("e", 2.0, None)]


def test_long_and_wide_round_trip(spark):
    rows = [(i, float(i), None if i % 3 else float(-i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    long = reshape.to_long(df, ["id"], ["a", "b"])
    assert long.count() == 40
    back = reshape.to_wide(long, ["id"], "name", "value", ["a", "b"]).orderBy("id")
    assert one(back) == rows


def test_replace_slice_drops_unknown_years(spark):
    base = spark.createDataFrame([(2000, "a"), (2001, "b"), (None, "c")], "year int, x string")
    patch = spark.createDataFrame([(2001, "new")], "year int, x string")
    assert sorted(one(reshape.replace_slice(base, patch, F.col("year") == 2001))) == [(2000, "a"), (2001, "new")]


def test_outer_merge_null_keys(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "c"), (None, "d"), (2, "e")], "k int, y string")
    assert sorted(one(joins.merge_outer(a, b, ["k"]))) == [(1, "a", "c"), (2, None, "e")]
    matched = joins.merge_outer(a, b, ["k"], null_keys="match")
    assert set(one(matched)) == {(None, "b", "d"), (1, "a", "c"), (2, None, "e")}


def test_phase_edges(spark):
    from tarnis.sources.phases import phase_table

    phases = phase_table(spark, [("a", 1990, 1992), ("b", 1992, 1995), ("c", 1994, 1996)])
    years = spark.createDataFrame([(y,) for y in (1989, 1990, 1992, 1994, 1996, None)], "year int")
    got = {(r.year, r.phase) for r in joins.label_phases(years, phases, "year").collect()}
    assert got == {(1989, None), (1990, "a"), (1992, "b"), (1994, "b"), (1994, "c"), (1996, None), (None, None)}
    both = {(r.year, r.phase) for r in joins.label_phases(years, phases, "year", closed="both").collect()}
    assert (1992, "a") in both and (1996, "c") in both


def test_phase_join_is_a_broadcast_hash_join(spark, sf):
    from tarnis.sources.phases import SOI_PHASES, phase_table

    df = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("year", F.year("l_shipdate"))
    out = joins.label_phases(df, phase_table(spark, SOI_PHASES), "year")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Exchange hashpartitioning" not in plan


def test_expanded_months_have_their_days(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 1), 1.0), (dt.date(2001, 2, 1), 2.0), (dt.date(2001, 12, 1), 3.0)], "m date, x double")
    got = dict(joins.expand_months(df, "m", ["x"]).groupBy("x").count().collect())
    assert got == {1.0: 29, 2.0: 28, 3.0: 31}


def test_monthly_join_equals_expansion(spark):
    monthly = spark.createDataFrame([(dt.date(2000, m, 1), float(m)) for m in range(1, 13)], "m date, x double")
    days = spark.sql("SELECT explode(sequence(DATE '2000-01-15', DATE '2000-12-20')) AS date")
    a = joins.join_monthly(days, monthly, "date", "m").select("date", "x")
    b = days.join(joins.expand_months(monthly, "m", ["x"]), "date").select("date", "x")
    assert sorted(one(a)) == sorted(one(b))


def test_grid_covers_the_bounds(spark):
    df = spark.createDataFrame([(1.0, 10.0, "s"), (3.0, 30.0, "s"), (5.0, 5.0, "t")], "x double, y double, site string")
    g = joins.grid(df, {"x": 3, "y": 2}, {"mid": F.max("y")}, by=["site"])
    got = sorted(one(g.where("site = 's'").drop("site")))
    assert got == [(0, 1.0, 10.0, 30.0), (1, 1.0, 30.0, 30.0), (2, 2.0, 10.0, 30.0), (3, 2.0, 30.0, 30.0), (4, 3.0, 10.0, 30.0), (5, 3.0, 30.0, 30.0)]


def test_mask_far_against_all_distances(spark):
    import random

    rng = random.Random(3)
    obs = [(rng.random() ** 2 * 40 + 1980, rng.random() ** 3 * 365) for _ in range(60)]
    df = spark.createDataFrame(obs, "x double, y double")
    lattice = joins.grid(df, {"x": 25, "y": 17})
    got = {r.grid_id: r.too_far for r in joins.mask_far(lattice, df, ("x", "y"), 0.1, (25, 17)).collect()}
    assert len(got) == 25 * 17
    x0, x1 = min(o[0] for o in obs), max(o[0] for o in obs)
    y0, y1 = min(o[1] for o in obs), max(o[1] for o in obs)
    for i in range(25):
        for j in range(17):
            near = min(math.hypot((x - x0) / (x1 - x0) - i / 24, (y - y0) / (y1 - y0) - j / 16) for x, y in obs)
            assert got[i * 17 + j] == (near > 0.1)
    assert any(got.values()) and not all(got.values())


def test_bind_by_index_pads(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "i long, x string")
    b = spark.createDataFrame([(0, "c"), (1, "d"), (2, "e")], "i long, y string")
    assert sorted(one(joins.bind_by_index(a, b, "i"))) == [(0, "a", "c"), (1, "b", "d"), (2, None, "e")]
