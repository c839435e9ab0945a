"""Aggregations and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tarnis.operators import quantiles, regression, summary
from tarnis.operators.summary import DECADES, FIGURE_DECADES


@query(
    """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd,
    min(value) AS min, max(value) AS max, count(*) AS count FROM events GROUP BY 1"""
)
def parameter_summary(spark, d):
    return rounded(summary.summary6(table(spark, d, "events"), "value", ["event_type"]))


@query(
    """SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS sd,
    min(x) AS min, max(x) AS max, count(*) AS count FROM (SELECT nullif(l_discount, 0) AS x FROM lineitem)"""
)
def overall_summary(spark, d):
    df = table(spark, d, "lineitem").select(F.nullif("l_discount", F.lit(0)).alias("x"))
    return rounded(summary.summary6(df, "x"))


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS max,
    date_trunc('second', median(o_orderdate)) AS median_date FROM orders GROUP BY 1"""
)
def annual_extreme_median_date(spark, d):
    out = summary.annual_extreme(table(spark, d, "orders"), "o_totalprice", "o_orderdate", "max")
    return out.withColumn("median_date", F.date_trunc("second", "median_date").cast("timestamp_ntz"))


def _decades_sql(breaks, strict):
    parts = []
    for label, start, end in breaks:
        lower = "" if start is None else f" AND m {'>' if strict else '>='} TIMESTAMP '{start}'"
        parts.append(f"SELECT '{label}' AS decade, x FROM a WHERE m < TIMESTAMP '{end}'{lower}")
    return (
        "WITH a AS (SELECT max(l_quantity + l_tax) AS x, median(l_shipdate) AS m FROM lineitem GROUP BY year(l_shipdate))"
        " SELECT decade, round(avg(x), 6) AS mean, count(*) AS years FROM (" + " UNION ALL ".join(parts) + ") GROUP BY decade"
    )


def _decades(spark, d, breaks, open_start):
    df = table(spark, d, "lineitem").select("l_shipdate", (F.col("l_quantity") + F.col("l_tax")).alias("x"))
    annual = summary.annual_extreme(df, "x", "l_shipdate", "max")
    return rounded(summary.decadal_mean(annual, "max", "median_date", breaks, open_start=open_start))


@query(_decades_sql(DECADES, False))
def decadal_mean(spark, d):
    return _decades(spark, d, DECADES, False)


@query(_decades_sql(FIGURE_DECADES, True))
def decadal_mean_figure(spark, d):
    return _decades(spark, d, FIGURE_DECADES, True)


@query(
    """SELECT round(max(m) - min(m), 6) AS between_year_range, round(max(m) / min(m), 6) AS extreme_range,
    round(avg(m), 6) AS avg_year, round(max(m) / avg(m), 6) AS extreme_factor, round(avg(r), 6) AS avg_within_year_range,
    max(r) AS max_within_year_range FROM
    (SELECT avg(l_quantity) AS m, max(l_quantity) - min(l_quantity) AS r FROM lineitem GROUP BY year(l_shipdate))"""
)
def temporal_ranges(spark, d):
    return rounded(summary.temporal_ranges(table(spark, d, "lineitem"), "l_quantity", F.year("l_shipdate")))


@query(
    """SELECT round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median, round(avg(x), 6) AS mean,
    round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max, count(*) - count(x) AS nulls
    FROM (SELECT nullif(l_extendedprice * l_discount, 0) AS x FROM lineitem)"""
)
def quartile_summary(spark, d):
    x = F.nullif(F.col("l_extendedprice") * F.col("l_discount"), F.lit(0))
    return rounded(summary.summary_quartiles(table(spark, d, "lineitem").select(x.alias("x")), "x"))


@query(
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
    round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1"""
)
def quantiles_by_year(spark, d):
    df = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_extendedprice")
    return rounded(quantiles.quantiles(df, "l_extendedprice", [0.1, 0.9], ["year"], ["p10", "p90"]))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 9) AS corr FROM lineitem"
        for i, a in enumerate(_CORR)
        for b in _CORR[i + 1 :]
    )
)
def corr_matrix(spark, d):
    return rounded(summary.corr_matrix(table(spark, d, "lineitem"), _CORR), 9)


def _histogram_sql(column):
    return f"""SELECT '{column}' AS variable, CAST(greatest(ceil((x - origin) / w) - 1, 0) AS INTEGER) AS bin, count(*) AS n
    FROM (SELECT {column} AS x, w, (floor(lo / w - 0.5) + 0.5) * w AS origin FROM lineitem,
        (SELECT min({column}) AS lo, (max({column}) - min({column})) / 29 AS w FROM lineitem)) GROUP BY ALL"""


@query(_histogram_sql("l_extendedprice") + " UNION ALL " + _histogram_sql("l_quantity"))
def histogram30(spark, d):
    made = summary.histogram(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    return made.select("variable", "bin", "n")


@query(
    """SELECT "group", count(*) AS n FROM (SELECT CASE WHEN l_quantity IS NULL THEN NULL WHEN l_quantity >= 25.5
    THEN 'Above/Equal' ELSE 'Below' END AS "group" FROM (SELECT nullif(l_quantity, 50) AS l_quantity FROM lineitem)) GROUP BY 1"""
)
def threshold_group(spark, d):
    df = table(spark, d, "lineitem").select(F.nullif("l_quantity", F.lit(50)).alias("q"))
    return summary.threshold_group(df, "q", 25.5).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT CASE WHEN l_quantity >= 25.5 THEN 'Above/Equal' ELSE 'Below' END AS "group", l_extendedprice / 1000 AS x FROM lineitem),
    b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 511 AS step FROM v),
    s AS (SELECT "group", count(*) AS n, 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34)
        * pow(count(*), -0.2) AS bw FROM v GROUP BY 1),
    c AS (SELECT "group", least(floor((x - lo) / step), 510) AS cell, (x - lo) / step - least(floor((x - lo) / step), 510) AS part FROM v, b),
    w AS (SELECT "group", cell, sum(w) AS w FROM (SELECT "group", cell, 1 - part AS w FROM c UNION ALL SELECT "group", cell + 1, part FROM c) GROUP BY ALL),
    g AS (SELECT unnest(range(0, 512)) AS i)
    SELECT w."group", CAST(i AS INTEGER) AS point, round(sum(w * exp(-0.5 * pow((i - cell) * step / bw, 2)) / (n * bw * 2.5066282746310002)), 9) AS density
    FROM w JOIN s ON w."group" = s."group", g, b GROUP BY 1, 2"""
)
def density_by_group(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("x"))
    grouped = summary.threshold_group(df, "l_quantity", 25.5)
    return rounded(summary.density(grouped, "x", ["group"]).select("group", "point", "density"), 9)


@query(
    """WITH s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx,
        regr_syy(y, x) AS syy, avg(x) AS mx FROM (SELECT o_totalprice / 1000 AS y, o_custkey::DOUBLE AS x FROM orders)),
    v AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM s)
    SELECT '(Intercept)' AS term, round(a, 6) AS estimate, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS se FROM v
    UNION ALL SELECT 'o_custkey', round(b, 6), round(sqrt(s2 / sxx), 6) FROM v"""
)
def ols(spark, d):
    df = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("y"), "o_custkey")
    fit = regression.ols(df, "y", ["o_custkey"])
    return rounded(fit.coefficients().select("term", "estimate", "se"))


@query(
    """WITH m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT o_totalprice / 1000 AS y, o_custkey::DOUBLE AS x FROM orders)),
    r AS (SELECT o_totalprice / 1000 - a - b * o_custkey AS r FROM orders, m)
    SELECT round(min(r), 5) AS min, round(quantile_cont(r, 0.25), 5) AS q1, round(median(r), 5) AS median,
    round(quantile_cont(r, 0.75), 5) AS q3, round(max(r), 5) AS max FROM r"""
)
def ols_residuals(spark, d):
    df = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("y"), "o_custkey")
    return rounded(regression.ols(df, "y", ["o_custkey"]).residual_summary(), 5)
