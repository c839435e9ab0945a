"""Smooth models whose fit has a closed form. A basis with as many functions as its covariate has values, left unpenalised, must give the
mean of every value, whatever the basis; a balanced random effect has a REML estimate in sums of squares. So bases, tensor products, standard
errors, derivatives, curves, surfaces, the basis check, missing rows and given autoregressive errors are compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tarnis.operators.reshape import bind_rows
from tarnis.smooth import check, gam, linear, re, s, te, ti
from tarnis.smooth.fit import AR

_ENDS = {"l_discount": (0, 0.11)}
_SMOOTHS = {
    "cr": s("l_discount", bs="cr", k=11),
    "tp": s("l_discount", bs="tp", k=11),
    "cc": s("l_discount", bs="cc", k=12, knots=_ENDS),
}

# groups of equal discount, and the spread within them
_BY_VALUE = """g AS (SELECT l_discount AS x, count(*) AS n, avg(sqrt(l_quantity)) AS m, var_pop(sqrt(l_quantity)) AS v FROM lineitem GROUP BY 1),
    t AS (SELECT sum(n) AS n, sum(n * v) AS w, sum(n * v) / (sum(n) - count(*)) AS s2, sum(n * m) / sum(n) AS mean FROM g)"""


def _saturated(spark, d, basis):
    rows = table(spark, d, "lineitem")
    return rows, gam(rows, "sqrt(l_quantity)", [_SMOOTHS[basis]], lam=0.0)


@query(
    f"""WITH {_BY_VALUE} SELECT basis, x, g.n AS n, round(m, 5) AS fit, round(sqrt(s2 / g.n), 5) AS se
    FROM g, t, (SELECT unnest({list(_SMOOTHS)}) AS basis)"""
)
def gam_saturated_smooth(spark, d):
    """Means and standard errors by value, from a cubic, a thin plate and a cyclic basis."""
    out = []
    for basis in _SMOOTHS:
        rows, model = _saturated(spark, d, basis)
        made = model.predict(rows).groupBy(F.lit(basis).alias("basis"), F.col("l_discount").alias("x"))
        out.append(made.agg(F.count("fit").alias("n"), F.avg("fit").alias("fit"), F.avg("se").alias("se")))
    return rounded(bind_rows(*out), 5)


@query(
    f"""WITH {_BY_VALUE}, b AS (SELECT sum(g.n * (m - mean) * (m - mean)) AS ssb FROM g, t)
    SELECT basis, 's(l_discount)' AS term, 10.0::DOUBLE AS edf, 10 AS max_df, round(ssb / 10 / s2, 4) AS f, round(s2, 5) AS scale,
    round(ssb / (ssb + w), 8) AS deviance_explained FROM b, t, (SELECT unnest({list(_SMOOTHS)}) AS basis)"""
)
def gam_saturated_summary(spark, d):
    """Degrees of freedom and F of a smooth that is free to take any value: analysis of variance."""
    out = []
    for basis in _SMOOTHS:
        model = _saturated(spark, d, basis)[1]
        numbers = model.statistics().select(F.round("scale", 5).alias("scale"), F.round("deviance_explained", 8).alias("deviance_explained"))
        terms = model.summary().select(F.lit(basis).alias("basis"), "term", F.round("edf", 6).alias("edf"), F.col("max_df").cast("int").alias("max_df"), F.round("f", 4).alias("f"))
        out.append(terms.crossJoin(numbers))
    return bind_rows(*out)


_TENSORS = {
    "te": [te("l_discount", "l_tax", k=(11, 9))],
    "ti": [s("l_discount", bs="cr", k=11), s("l_tax", bs="cr", k=9), ti("l_discount", "l_tax", k=(11, 9))],
}


@query(
    f"""SELECT kind, l_discount, l_tax, n, round(m, 5) AS fit FROM
    (SELECT l_discount, l_tax, count(*) AS n, avg(sqrt(l_quantity)) AS m FROM lineitem GROUP BY 1, 2), (SELECT unnest({list(_TENSORS)}) AS kind)"""
)
def gam_tensor_cells(spark, d):
    """The mean of every pair of values, from a tensor product, and from main effects and their interaction."""
    rows = table(spark, d, "lineitem")
    out = []
    for kind, terms in _TENSORS.items():
        made = gam(rows, "sqrt(l_quantity)", terms, lam=0.0).predict(rows, se=False)
        out.append(made.groupBy(F.lit(kind).alias("kind"), "l_discount", "l_tax").agg(F.count("fit").alias("n"), F.avg("fit").alias("fit")))
    return rounded(bind_rows(*out), 5)


@query(
    """SELECT l_discount, line, round(avg(sqrt(l_quantity)), 5) AS value, FALSE AS too_far
    FROM (SELECT *, CAST(l_partkey % 11 AS DOUBLE) AS line FROM lineitem) GROUP BY 1, 2"""
)
def gam_surface_cells(spark, d):
    """The response surface on a grid that meets all pairs of values: their means."""
    rows = table(spark, d, "lineitem").withColumn("line", F.pmod("l_partkey", F.lit(11)).cast("double"))
    model = gam(rows, "sqrt(l_quantity)", [te("l_discount", "line", k=(11, 11))], lam=0.0)
    shown = model.response_surface("te(l_discount,line)", n=11)
    return rounded(shown.select(F.round("l_discount", 2).alias("l_discount"), F.round("line", 6).alias("line"), "value", "too_far"), 5)


@query(
    """WITH g AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(isodow(l_shipdate) AS INTEGER) AS day, count(*) AS n, avg(sqrt(l_quantity)) AS m,
        var_pop(sqrt(l_quantity)) AS v FROM lineitem GROUP BY 1, 2),
    t AS (SELECT sum(n * v) / (sum(n) - count(*)) AS s2 FROM g)
    SELECT year, day, round(m, 5) AS fit, round(sqrt(s2 / n), 5) AS se FROM g, t"""
)
def gam_curves_cells(spark, d):
    """A curve for every year over the days of the week: means by year and day."""
    rows = table(spark, d, "lineitem").select("l_quantity", F.year("l_shipdate").alias("year"), (F.weekday("l_shipdate") + 1).alias("day"))
    years = rows.select("year").distinct().count()
    model = gam(rows, "sqrt(l_quantity)", [te("year", "day", k=(years, 7))], lam=0.0)
    return rounded(model.seasonal_curves("year", "day", days=7).select("year", "day", "fit", "se"), 5)


# natural cubic spline through the means of three values
_THREE = "CASE WHEN l_returnflag = 'A' THEN 0.0 WHEN l_returnflag = 'N' THEN 1.0 ELSE 3.0 END"
_SLOPES = f"""v AS (SELECT sqrt(l_quantity) AS y, CAST({_THREE} AS DOUBLE) AS x FROM lineitem),
    g AS (SELECT x, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM v GROUP BY x),
    t AS (SELECT sum(n * v) / (sum(n) - 3) AS s2 FROM g),
    w AS (SELECT max(CASE WHEN x = 0 THEN m END) AS m0, max(CASE WHEN x = 1 THEN m END) AS m1, max(CASE WHEN x = 3 THEN m END) AS m2,
        max(CASE WHEN x = 0 THEN n END) AS n0, max(CASE WHEN x = 1 THEN n END) AS n1, max(CASE WHEN x = 3 THEN n END) AS n2 FROM g),
    p AS (SELECT unnest(range(0, 31)) AS i),
    -- weights of the three means in the second derivative at the middle knot, and in the slope
    c AS (SELECT i, i / 10.0 AS x, CASE WHEN i <= 10 THEN (3 * (i / 10.0) * (i / 10.0) - 1) / 6 ELSE (4 - 3 * (3 - i / 10.0) * (3 - i / 10.0)) / 12 END AS q FROM p),
    k AS (SELECT i, x, CASE WHEN i <= 10 THEN -1 ELSE 0 END + q * 1.0 AS w0, CASE WHEN i <= 10 THEN 1 ELSE -0.5 END - q * 1.5 AS w1,
        CASE WHEN i <= 10 THEN 0 ELSE 0.5 END + q * 0.5 AS w2 FROM c)"""


@query(
    f"""WITH {_SLOPES}, r AS (SELECT i, w0 * m0 + w1 * m1 + w2 * m2 AS d, sqrt(s2 * (w0 * w0 / n0 + w1 * w1 / n1 + w2 * w2 / n2)) AS e FROM k, w, t)
    SELECT CAST(i AS INTEGER) AS i, round(d, 5) AS derivative, round(e, 5) AS derivative_se, round(d - 1.96 * e, 4) AS lower_ci, round(d + 1.96 * e, 4) AS upper_ci FROM r"""
)
def gam_spline_slope(spark, d):
    """Slope of a natural cubic spline through three means, with its interval."""
    rows = table(spark, d, "lineitem").select("l_quantity", F.expr(_THREE).cast("double").alias("x"))
    made = gam(rows, "sqrt(l_quantity)", [s("x", bs="cr", k=3)], lam=0.0).smooth_derivative("s(x)", n=31)
    made = made.select(F.round(F.col("x") * 10).cast("int").alias("i"), "derivative", "derivative_se", "lower_ci", "upper_ci")
    return rounded(rounded(made, 5, ["derivative", "derivative_se"]), 4, ["lower_ci", "upper_ci"])


@query(
    f"""WITH {_BY_VALUE}, j AS (SELECT n, v, v + lag(v) OVER (ORDER BY x) AS jump FROM g)
    SELECT 's(l_discount)' AS term, 10 AS max_df, 10.0::DOUBLE AS edf,
    round((sum(2 * j.n * v) + sum(jump)) / (2 * (sum(j.n) - 1)) / (sum(j.n * v) / (sum(j.n) - 1)), 7) AS k_index FROM j"""
)
def gam_kcheck_values(spark, d):
    """The basis check where no structure is left: residuals of a saturated smooth."""
    made = check.k_check(_saturated(spark, d, "cr")[1])
    return made.select("term", F.col("max_df").cast("int").alias("max_df"), F.round("edf", 6).alias("edf"), F.round("k_index", 7).alias("k_index"))


@query(
    """WITH g AS (SELECT l_discount AS x, l_tax AS z, count(*) AS n, var_pop(sqrt(l_quantity)) AS v FROM lineitem GROUP BY 1, 2),
    e AS (SELECT max(CASE WHEN x = (SELECT min(x) FROM g) AND z = (SELECT min(z) FROM g) THEN v END) + max(CASE WHEN x = (SELECT max(x) FROM g)
        AND z = (SELECT min(z) FROM g) THEN v END) AS ends FROM g)
    SELECT 'te(l_discount,l_tax)' AS term, CAST(count(*) - 1 AS INTEGER) AS max_df,
    round((sum(2 * n * v) + 2 * sum(v) - min(ends)) / (2 * (sum(n) - 1)) / (sum(n * v) / (sum(n) - 1)), 7) AS k_index FROM g, e"""
)
def gam_kcheck_cells(spark, d):
    """The same for a smooth of two variables: the curve through all pairs begins at one corner and ends at the next."""
    rows = table(spark, d, "lineitem")
    made = check.k_check(gam(rows, "sqrt(l_quantity)", [te("l_discount", "l_tax", k=(11, 9))], lam=0.0))
    return made.select("term", F.col("max_df").cast("int").alias("max_df"), F.round("k_index", 7).alias("k_index"))


_HOLES = {"y": "CASE WHEN l_linenumber = 2 THEN NULL ELSE sqrt(l_quantity) END", "x": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END"}


@query(
    f"""WITH v AS (SELECT {_HOLES["y"]} AS y, {_HOLES["x"]} AS x FROM lineitem), g AS (SELECT x, avg(y) AS m FROM v WHERE x IS NOT NULL GROUP BY x)
    SELECT v.x, count(*) AS n, count(y) AS known, round(min(m), 5) AS fit, (SELECT count(*) FROM v WHERE x IS NOT NULL AND y IS NOT NULL) AS rows_of_fit
    FROM v LEFT JOIN g ON v.x = g.x GROUP BY v.x"""
)
def gam_missing_rows(spark, d):
    """Rows with a missing value stay out of the fit; a prediction is missing where a covariate is, not where the response is."""
    nan = F.lit(float("nan"))
    rows = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 2, nan).otherwise(F.sqrt("l_quantity")).alias("y"), F.expr(_HOLES["x"]).alias("x")
    )
    model = gam(rows, "y", [s("x", bs="cr", k=11)], lam=0.0)
    made = model.predict(rows, se=False).groupBy("x").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.nanvl("y", F.lit(None).cast("double"))).alias("known"), F.min("fit").alias("fit")
    )
    return rounded(made.withColumn("rows_of_fit", F.lit(model.n).cast("long")), 5)


_PHI = 0.4


@query(
    f"""WITH v AS (SELECT o_totalprice / 1000 AS y, CAST(o_custkey AS DOUBLE) AS x, lag(o_totalprice / 1000) OVER w AS y1, lag(CAST(o_custkey AS DOUBLE)) OVER w AS x1
        FROM orders WINDOW w AS (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey)),
    r AS (SELECT CASE WHEN y1 IS NULL THEN sqrt(1 - {_PHI} * {_PHI}) ELSE 1 - {_PHI} END AS i, CASE WHEN y1 IS NULL THEN y * sqrt(1 - {_PHI} * {_PHI}) ELSE y - {_PHI} * y1 END AS y,
        CASE WHEN y1 IS NULL THEN x * sqrt(1 - {_PHI} * {_PHI}) ELSE x - {_PHI} * x1 END AS x FROM v),
    c AS (SELECT count(*) AS n, sum(i * i) AS ii, sum(i * x) AS ix, sum(x * x) AS xx, sum(i * y) AS iy, sum(x * y) AS xy, sum(y * y) AS yy FROM r),
    b AS (SELECT *, ii * xx - ix * ix AS det, (iy * xx - ix * xy) / (ii * xx - ix * ix) AS a, (ii * xy - ix * iy) / (ii * xx - ix * ix) AS b FROM c),
    e AS (SELECT *, (yy - a * iy - b * xy) / (n - 2) AS s2 FROM b)
    SELECT '(Intercept)' AS coefficient, round(a, 5) AS estimate, round(sqrt(s2 * xx / det), 6) AS se FROM e
    UNION ALL SELECT 'o_custkey.1', round(b, 5), round(sqrt(s2 * ii / det), 6) FROM e"""
)
def gam_given_ar(spark, d):
    """A line with autoregressive errors of a given coefficient within years: least squares of the whitened rows."""
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    model = gam(rows, "o_totalprice / 1000", [linear("o_custkey")], ar=AR(1, "year", ("o_orderdate", "o_orderkey"), phi=(_PHI,)))
    return rounded(rounded(model.coefficients(), 5, ["estimate"]), 6, ["se"])


# balanced: twelve months for each level
_MONTHS = """m AS (SELECT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS level, month(l_shipdate) AS month, avg(l_quantity * l_tax) AS y
        FROM lineitem GROUP BY 1, 2),
    b AS (SELECT level, y FROM m WHERE level IN (SELECT level FROM m GROUP BY level HAVING count(*) = 12)),
    g AS (SELECT level, avg(y) AS mean, var_pop(y) * 12 AS w FROM b GROUP BY level),
    q AS (SELECT count(*) AS levels, avg(mean) AS mean, sum(w) / (11 * count(*)) AS msw, 12 * var_samp(mean) AS msb FROM g),
    r AS (SELECT *, 12 * msw / (msb - msw) AS ratio FROM q)"""


@query(
    f"""WITH {_MONTHS} SELECT level, round(g.mean - r.mean - (g.mean - r.mean) * ratio / (12 + ratio), 5) AS effect, round(r.mean, 5) AS "constant",
    round(msw, 6) AS scale, round(msw / ratio, 5) AS level_variance, round(1 + (levels - 1) * 12 / (12 + ratio), 5) AS edf FROM g, r"""
)
def gam_random_levels(spark, d):
    """A balanced random effect: REML in closed form, from the mean squares between and within levels."""
    cells = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").cast("string").alias("level"), F.month("l_shipdate").alias("month"))
    cells = cells.agg(F.avg(F.col("l_quantity") * F.col("l_tax")).alias("y"))
    full = cells.groupBy("level").agg(F.count(F.lit(1)).alias("n")).where("n = 12").select("level")
    rows = cells.join(full, "level")
    model = gam(rows, "y", [re("level")])
    made = model.predict_terms(rows.select("level").distinct(), "s(level)")
    made = made.select("level", "effect", "constant", F.lit(model.scale).alias("scale"), F.lit(model.scale / model.level.ratio).alias("level_variance"), F.lit(model.edf).alias("edf"))
    return rounded(rounded(made, 5, ["effect", "constant", "level_variance", "edf"]), 6, ["scale"])
