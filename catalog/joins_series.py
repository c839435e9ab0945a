"""Joins, grids and series."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tarnis.functions import columns as c
from tarnis.operators import frame, joins, order, series, summary
from tarnis.sources.phases import IN_PHASE, PDO_PHASES, phase_table


def phase_values(rows) -> str:
    return "(VALUES " + ", ".join(f"('{p}', {a}, {b})" for p, a, b in rows) + ") AS p(phase, s, e)"


@query(
    f"""SELECT year, mean, max, min, phase FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
    avg(l_quantity) AS mean, max(l_quantity) AS max, min(l_quantity) AS min FROM lineitem
    WHERE l_quantity IS NOT NULL GROUP BY 1) LEFT JOIN {phase_values(PDO_PHASES)} ON year >= s AND year < e"""
)
def annual_phase_timeline(spark, d):
    annual = summary.annual_summary(table(spark, d, "lineitem"), "l_quantity", "l_shipdate")
    return joins.label_phases(annual, phase_table(spark, PDO_PHASES), "year")


@query(
    f"""SELECT phase, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
    LEFT JOIN {phase_values(IN_PHASE)} ON year(l_shipdate) >= s AND year(l_shipdate) < e GROUP BY phase"""
)
def phase_of_reading(spark, d):
    df = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    labelled = joins.label_phases(df, phase_table(spark, IN_PHASE), "year")
    return labelled.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    """SELECT phase, count(*) AS n FROM orders LEFT JOIN (VALUES ('dry', DATE '1995-03-10', DATE '1996-07-01'),
    ('wet', DATE '1996-07-01', DATE '1999-12-31'), ('mixed', DATE '1999-11-01', DATE '2000-02-29')) AS p(phase, s, e)
    ON o_orderdate >= s AND o_orderdate < e GROUP BY phase"""
)
def date_phases(spark, d):
    spans = phase_table(
        spark,
        [
            ("dry", dt.date(1995, 3, 10), dt.date(1996, 7, 1)),
            ("wet", dt.date(1996, 7, 1), dt.date(1999, 12, 31)),
            ("mixed", dt.date(1999, 11, 1), dt.date(2000, 2, 29)),
        ],
    )
    labelled = joins.label_date_phases(table(spark, d, "orders"), spans, "o_orderdate")
    return labelled.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


def _annual(df, value, date):
    return summary.annual_summary(df, value, date)


@query(
    """SELECT a.year, a.mean AS mean_x, a.max AS max_x, a.min AS min_x, b.mean AS mean_y, b.max AS max_y, b.min AS min_y
    FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) AS mean, max(l_quantity) AS max,
          min(l_quantity) AS min FROM lineitem GROUP BY 1) a
    JOIN (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS max,
          min(o_totalprice) AS min FROM orders GROUP BY 1) b ON a.year = b.year"""
)
def merge_inner(spark, d):
    a = _annual(table(spark, d, "lineitem"), "l_quantity", "l_shipdate")
    b = rounded(_annual(table(spark, d, "orders"), "o_totalprice", "o_orderdate"), 4)
    return joins.merge_inner(a, b, ["year"])


@query(
    """SELECT c_custkey, n, latest FROM customer LEFT JOIN
    (SELECT o_custkey AS c_custkey, count(*) AS n, max(o_orderdate)::DATE AS latest FROM orders GROUP BY 1) USING (c_custkey)"""
)
def merge_left(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("o_orderdate").cast("date")).alias("latest")
    )
    return joins.merge_left(table(spark, d, "customer").select("c_custkey"), counts, ["c_custkey"])


@query(
    """SELECT row_id, c_custkey, p_partkey FROM
    (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_id, c_custkey FROM customer)
    FULL JOIN (SELECT row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS row_id, p_partkey FROM part) USING (row_id)"""
)
def bind_by_index(spark, d):
    a = order.with_row_index(table(spark, d, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"])
    b = order.with_row_index(table(spark, d, "part").select("p_size", "p_partkey"), ["p_size", "p_partkey"])
    return joins.bind_by_index(a.drop("c_acctbal"), b.drop("p_size"), "row_id")


_MONTHLY = """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n,
    max(o_totalprice) AS top FROM orders GROUP BY 1"""


def _monthly(spark, d):
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
    return table(spark, d, "orders").groupBy(month).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")
    )


@query(
    f"""SELECT unnest(generate_series(month, month + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date,
    n, top FROM ({_MONTHLY})"""
)
def expand_months(spark, d):
    return joins.expand_months(_monthly(spark, d), "month", ["n", "top"])


@query(
    f"""SELECT date, quantity, n FROM (SELECT l_shipdate::DATE AS date, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
    JOIN (SELECT (month - INTERVAL 6 MONTH)::DATE AS month, n FROM ({_MONTHLY})) m ON date_trunc('month', date) = m.month"""
)
def month_shift_join(spark, d):
    daily = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("quantity")
    )
    shifted = _monthly(spark, d).select(c.shift_months("month", -6).alias("month"), "n")
    return joins.join_monthly(daily, shifted, "date", "month")


@query(
    """SELECT CAST(i * 29 + j AS BIGINT) AS grid_id, round(y0 + i * (y1 - y0) / 24.0, 6) AS year,
    round(d0 + j * (d1 - d0) / 28.0, 6) AS "DOY", q AS quantity
    FROM (SELECT min(year(l_shipdate)) AS y0, max(year(l_shipdate)) AS y1, min(dayofyear(l_shipdate)) AS d0,
        max(dayofyear(l_shipdate)) AS d1, median(l_quantity) AS q FROM lineitem),
    (SELECT unnest(range(0, 25)) AS i), (SELECT unnest(range(0, 29)) AS j)"""
)
def seasonal_grid(spark, d):
    df = table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("DOY"), "l_quantity"
    )
    # quantities are whole numbers below 51, so the median's value counts stay few
    made = joins.grid(df, {"year": 25, "DOY": 29}, {"quantity": F.median("l_quantity")})
    return rounded(made)


@query(
    """WITH obs AS (SELECT epoch(date_trunc('day', l_shipdate)) / 86400.0 AS x, avg(l_quantity) AS y FROM lineitem GROUP BY 1),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM obs),
    g AS (SELECT i * 30 + j AS grid_id, i / 29.0 AS u, j / 29.0 AS v FROM (SELECT unnest(range(0, 30)) AS i),
        (SELECT unnest(range(0, 30)) AS j)),
    o AS (SELECT (x - x0) / (x1 - x0) AS u, (y - y0) / (y1 - y0) AS v FROM obs, b)
    SELECT CAST(grid_id AS BIGINT) AS grid_id, NOT EXISTS (SELECT 1 FROM o
        WHERE sqrt((o.u - g.u) * (o.u - g.u) + (o.v - g.v) * (o.v - g.v)) <= 0.1) AS too_far FROM g"""
)
def mask_far(spark, d):
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("double")
    obs = table(spark, d, "lineitem").groupBy(day.alias("x")).agg(F.avg("l_quantity").alias("y"))
    lattice = joins.grid(obs, {"x": 30, "y": 30})
    return joins.mask_far(lattice, obs, ("x", "y"), 0.1, (30, 30)).select("grid_id", "too_far")


# --- series ------------------------------------------------------------------------------------


@query(
    f"""SELECT month, CASE WHEN count(n) OVER w = 3 THEN round(avg(n) OVER w, 6) END AS n_mean3
    FROM ({_MONTHLY}) WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""
)
def centered_mean_monthly(spark, d):
    # one row per month
    out = series.centered_mean(_monthly(spark, d), "n", "month", bounded=True)
    return rounded(out.select("month", "n_mean3"))


@query(
    """SELECT o_orderkey, CASE WHEN count(x) OVER w = 5 THEN round(avg(x) OVER w, 6) END AS smooth FROM
    (SELECT *, nullif(o_custkey, 7) AS x FROM orders)
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def centered_mean_readings(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority", F.nullif("o_custkey", F.lit(7)).alias("x")
    )
    out = series.centered_mean(df, "x", ["o_orderdate", "o_orderkey"], 5, ["o_orderpriority"], "smooth")
    return rounded(out.select("o_orderkey", "smooth"))


def _daily_totals(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.sum("o_totalprice").alias("total")
    )


_DAILY_TOTALS = """SELECT row_number() OVER (ORDER BY date) AS i, total - avg(total) OVER () AS y FROM
    (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS total FROM orders GROUP BY 1)"""


@query(
    f"""WITH s AS ({_DAILY_TOTALS}) SELECT CAST(k AS INTEGER) AS lag,
    round(sum(a.y * b.y) / (SELECT sum(y * y) FROM s), 9) AS acf
    FROM (SELECT unnest(range(0, 37)) AS k), s a JOIN s b ON b.i = a.i + k GROUP BY k"""
)
def acf_daily(spark, d):
    return rounded(series.acf(_daily_totals(spark, d), "total", "date"), 9)


@query(
    """WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i,
        value - avg(value) OVER (PARTITION BY event_type) AS y FROM events)
    SELECT a.event_type, CAST(b.i - a.i AS INTEGER) AS lag, round(sum(a.y * b.y) / max(t.q), 9) AS acf
    FROM s a JOIN s b ON a.event_type = b.event_type AND b.i BETWEEN a.i AND a.i + 36
    JOIN (SELECT event_type, sum(y * y) AS q FROM s GROUP BY 1) t ON t.event_type = a.event_type GROUP BY 1, 2"""
)
def acf_readings(spark, d):
    return rounded(series.acf(table(spark, d, "events"), "value", ["ts", "event_id"], by=["event_type"]), 9)


@query(
    f"""WITH s AS ({_DAILY_TOTALS}), r AS (SELECT k, sum(a.y * b.y) / (SELECT sum(y * y) FROM s) AS r
        FROM (SELECT unnest(range(1, 3)) AS k), s a JOIN s b ON b.i = a.i + k GROUP BY k),
    p AS (SELECT (SELECT r FROM r WHERE k = 1) AS r1, (SELECT r FROM r WHERE k = 2) AS r2)
    SELECT 1 AS lag, round(r1, 9) AS pacf FROM p UNION ALL
    SELECT 2, round((r2 - r1 * r1) / (1 - r1 * r1), 9) FROM p"""
)
def pacf_daily(spark, d):
    """The first two lags have a closed form in SQL; the operator is asked for those two."""
    return rounded(series.pacf(_daily_totals(spark, d), "total", "date", max_lag=2), 9)


@query(
    """WITH RECURSIVE s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i,
        value - avg(value) OVER (PARTITION BY event_type) AS y FROM events),
    r AS (SELECT event_type, list(r ORDER BY k) AS r FROM (
        SELECT a.event_type, b.i - a.i AS k, sum(a.y * b.y) / max(t.q) AS r FROM s a JOIN s b ON a.event_type = b.event_type AND b.i BETWEEN a.i + 1 AND a.i + 36
        JOIN (SELECT event_type, sum(y * y) AS q FROM s GROUP BY 1) t ON t.event_type = a.event_type GROUP BY 1, 2) GROUP BY 1),
    steps AS (
        SELECT event_type, r, 1 AS k, [r[1]] AS phi, r[1] AS a, 1 - r[1] * r[1] AS v FROM r
        UNION ALL
        SELECT event_type, r, k + 1, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda p: p[1] - b * p[2]), b), b, v * (1 - b * b)
        FROM (SELECT *, (r[k + 1] - list_sum(list_transform(list_zip(phi, list_reverse(r[1:k])), lambda p: p[1] * p[2]))) / v AS b FROM steps WHERE k < len(r))
    )
    SELECT event_type, CAST(k AS INTEGER) AS lag, round(a, 8) AS pacf FROM steps"""
)
def pacf_readings(spark, d):
    return rounded(series.pacf(table(spark, d, "events"), "value", ["ts", "event_id"], by=["event_type"]), 8)


_RUNS = """WITH f AS (SELECT *, lag({flag}) OVER (ORDER BY {order}) AS prev FROM ({source})),
    g AS (SELECT *, sum(CASE WHEN {flag} AND NOT coalesce(prev, FALSE) THEN 1 ELSE 0 END) OVER (ORDER BY {order}) AS run FROM f)
    SELECT min({key}) AS start, max({key}) AS "end", count(*) AS n FROM g WHERE {flag} GROUP BY run"""


@query(
    _RUNS.format(
        flag="up", order="month", key="month",
        source=f"SELECT month, n > lag(n) OVER (ORDER BY month) AS up FROM ({_MONTHLY})",
    )
)
def change_periods(spark, d):
    monthly = order.over_neighbours(
        _monthly(spark, d), {"before": lambda w: F.lag("n").over(w)}, ["month"], before=1, bounded=True
    )
    flagged = monthly.withColumn("up", F.col("n") > F.col("before"))
    return series.change_periods(flagged, "month", "up", bounded=True)


@query(
    _RUNS.format(
        flag="high", order="day, o_orderkey", key="day",
        source="SELECT o_orderdate::DATE AS day, o_orderkey, o_totalprice >= 250000 AS high FROM orders",
    )
)
def change_periods_readings(spark, d):
    df = table(spark, d, "orders").select(
        F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", (F.col("o_totalprice") >= 250000).alias("high")
    )
    return series.change_periods(df, "day", "high", tie_breakers=["o_orderkey"])


@query(
    """SELECT month, lower <= 0 AND upper >= 0 AS "Null_test", CASE WHEN lower <= 0 AND upper >= 0 THEN 2 ELSE 1 END AS sig
    FROM (SELECT date_trunc('month', l_shipdate)::DATE AS month, avg(l_quantity) - 25.5 - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)) AS lower,
    avg(l_quantity) - 25.5 + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)) AS upper FROM lineitem GROUP BY 1)"""
)
def significant_change(spark, d):
    q = F.col("l_quantity")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")
    df = table(spark, d, "lineitem").groupBy(month).agg(
        (F.avg(q) - 25.5).alias("est"), (F.stddev_samp(q) / F.sqrt(F.count(q))).alias("se")
    )
    flagged = series.significant_change(frame.with_ci(df, "est", "se"))
    return flagged.select("month", "Null_test", "sig")


_PHI = (0.5, 0.2)
_W1 = _PHI[0] / (1 - _PHI[1])  # weight of the only earlier row
_V1 = 1 / (1 - _PHI[1] ** 2)
_V0 = _V1 / (1 - _W1**2)


@query(
    f"""SELECT o_orderkey, round(CASE WHEN r2 IS NOT NULL THEN r - {_PHI[0]} * r1 - {_PHI[1]} * r2
        WHEN r1 IS NOT NULL THEN (r - {_W1!r} * r1) / {math.sqrt(_V1)!r} ELSE r / {math.sqrt(_V0)!r} END, 5) AS normalized
    FROM (SELECT o_orderkey, r, lag(r) OVER w AS r1, lag(r, 2) OVER w AS r2 FROM
        (SELECT *, o_totalprice - 250000 AS r FROM orders)
        WINDOW w AS (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey))"""
)
def ar_residuals(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("year"), (F.col("o_totalprice") - 250000).alias("r")
    )
    out = series.ar_residuals(df, "r", ["o_orderdate", "o_orderkey"], ["year"], _PHI)
    return rounded(out.select("o_orderkey", "normalized"), 5)
