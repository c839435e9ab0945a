"""Models whose fit has a closed form, so the fitting, prediction and report code can be compared with
SQL on whole tables: straight lines, group means of every family, and a group effect with a given penalty."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tarnis.operators.reshape import bind_rows
from tarnis.smooth import check, gam, linear, re

# straight line: quantity on tax; tax has few values, so the rows are reduced before the fit
_LINE = """v AS (SELECT l_quantity AS y, l_tax AS x, l_shipdate::DATE AS date FROM lineitem),
    s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
        regr_r2(y, x) AS r2, count(*) AS n, avg(x) AS mx FROM v),
    f AS (SELECT *, syy * (1 - r2) AS dev, syy * (1 - r2) / (n - 2) AS s2 FROM s)"""


def _line(spark, d):
    rows = table(spark, d, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    return rows, gam(rows, "l_quantity", [linear("l_tax")])


@query(
    f"""WITH {_LINE}, l AS (SELECT *, -n / 2.0 * (ln(2 * pi() * dev / n) + 1) AS ll FROM f)
    SELECT n, 2.0::DOUBLE AS edf, round(s2, 6) AS scale, round(dev, 3) AS deviance, round(r2, 9) AS deviance_explained,
    round(1 - s2 / (syy / (n - 1)), 9) AS r2_adjusted, round(ll, 4) AS loglik, round(6 - 2 * ll, 4) AS aic,
    round(3 * ln(n) - 2 * ll, 4) AS bic FROM l"""
)
def gam_line_statistics(spark, d):
    out = _line(spark, d)[1].statistics().drop("family", "method", "criterion", "variance_power", "ar", "converged", "gradient")
    digits = {"edf": 6, "scale": 6, "deviance": 3, "deviance_explained": 9, "r2_adjusted": 9, "loglik": 4, "aic": 4, "bic": 4}
    for name, k in digits.items():
        out = rounded(out, k, [name])
    return out


@query(
    f"""WITH {_LINE} SELECT x, count(*) AS n, round(a + b * x, 6) AS fit, round(e, 6) AS se, round(a + b * x - 1.96 * e, 6) AS lower,
    round(a + b * x + 1.96 * e, 6) AS upper FROM (SELECT x, a, b, sqrt(s2 * (1.0 / n + (x - mx) * (x - mx) / sxx)) AS e FROM v, f)
    GROUP BY x, a, b, e"""
)
def gam_line_predict_ci(spark, d):
    rows, model = _line(spark, d)
    made = rounded(model.predict(rows).select(F.col("l_tax").alias("x"), "fit", "se", "lower", "upper"), 6, ["fit", "se", "lower", "upper"])
    return made.groupBy("x", "fit", "se", "lower", "upper").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_LINE} SELECT x, round(b * x, 6) AS effect, round(x * sqrt(s2 / sxx), 6) AS effect_se, round(a, 6) AS "constant"
    FROM (SELECT DISTINCT x FROM v), f"""
)
def gam_line_terms(spark, d):
    rows, model = _line(spark, d)
    made = model.predict_terms(rows.select(F.col("l_tax")), "l_tax").distinct()
    made = rounded(made, 6, ["effect", "effect_se", "constant"])
    return made.select(F.col("l_tax").alias("x"), "effect", "effect_se", "constant")


@query(
    f"""WITH {_LINE} SELECT date, 'l_tax' AS term, round(avg(b * x), 6) AS effect, round(avg(y - a), 6) AS partial_residual
    FROM v, f GROUP BY date"""
)
def gam_line_partial(spark, d):
    rows, model = _line(spark, d)
    long = model.partial_effects(rows, ["date"])
    return rounded(
        long.groupBy("date", "term").agg(
            F.avg("effect").alias("effect"), F.avg("partial_residual").alias("partial_residual")
        )
    )


@query(
    f"""WITH {_LINE} SELECT date, 'Observed' AS fit, round(avg(y), 6) AS value FROM v GROUP BY date
    UNION ALL SELECT date, 'Predicted', round(avg(a + b * x), 6) FROM v, f GROUP BY date"""
)
def gam_line_obs_pred(spark, d):
    rows, model = _line(spark, d)
    long = model.observed_vs_predicted(rows, ["date"])
    return rounded(long.groupBy("date", "fit").agg(F.avg("value").alias("value")))


@query(
    f"""WITH {_LINE}, r AS (SELECT date, y, a + b * x AS m, y - a - b * x AS e FROM v, f)
    SELECT date, round(avg(y), 6) AS observed, round(avg(m), 6) AS fitted, round(avg(e), 6) AS working,
    round(avg(abs(e)), 6) AS size FROM r GROUP BY date"""
)
def gam_line_diagnostics(spark, d):
    rows, model = _line(spark, d)
    made = check.diagnostics(model, rows)
    return rounded(
        made.groupBy("date").agg(
            F.avg("observed").alias("observed"),
            F.avg("fitted").alias("fitted"),
            F.avg("working").alias("working"),
            F.avg(F.abs("deviance")).alias("size"),
        )
    )


# two predictors against one
_TWO = """c AS (SELECT count(*) AS n, var_pop(l_quantity) AS yy, var_pop(l_tax) AS xx, var_pop(l_discount) AS ww,
        covar_pop(l_tax, l_discount) AS xw, covar_pop(l_quantity, l_tax) AS xy, covar_pop(l_quantity, l_discount) AS wy FROM lineitem),
    t AS (SELECT n, n * (yy - xy * xy / xx) AS dev_x, n * (yy - wy * wy / ww) AS dev_w,
        n * (yy - (xy * (xy * ww - wy * xw) + wy * (wy * xx - xy * xw)) / (xx * ww - xw * xw)) AS dev2 FROM c)"""


def _two(spark, d):
    return gam(table(spark, d, "lineitem"), "l_quantity", [linear("l_tax"), linear("l_discount")])


def _criterion(dev: str, k: int) -> str:
    return f"round(n * (ln(2 * pi() * {dev} / n) + 1) + 2 * {k}, 4)"


@query(
    f"""WITH {_TWO} SELECT 'full' AS model, 4.0::DOUBLE AS df, {_criterion("dev2", 4)} AS "AIC" FROM t
    UNION ALL SELECT 'l_tax', 3.0, {_criterion("dev_w", 3)} FROM t UNION ALL SELECT 'l_discount', 3.0, {_criterion("dev_x", 3)} FROM t"""
)
def gam_line_drop(spark, d):
    full = _two(spark, d)
    out = check.compare({"full": full, **check.drop_terms(full, ["l_tax", "l_discount"])})
    return rounded(out, 4)


@query(
    f"""WITH {_TWO} SELECT 1.0::DOUBLE AS df, round((dev_x - dev2) / (dev2 / (n - 3)), 6) AS statistic FROM t"""
)
def gam_line_lrt(spark, d):
    out = check.lrt(_line(spark, d)[1], _two(spark, d))
    return rounded(out.select("df", "statistic"))


# residuals of a line through the orders
_ORDERS = """v AS (SELECT o_totalprice / 1000 AS y, o_custkey::DOUBLE AS x, o_orderkey FROM orders),
    s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM v),
    r AS (SELECT y - a - b * x AS e, o_orderkey FROM v, s)"""


def _orders_line(spark, d):
    rows = table(spark, d, "orders").withColumn("price", F.col("o_totalprice") / 1000)
    return rows, gam(rows, "price", [linear("o_custkey")])


@query(f"WITH {_ORDERS} SELECT row_number() OVER (ORDER BY e, o_orderkey) - 1 AS rank, round(e, 6) AS sample FROM r")
def gam_line_qq(spark, d):
    rows, model = _orders_line(spark, d)
    return rounded(check.qq_points(model, rows, ["o_orderkey"]).select("rank", "sample"))


@query(
    f"""WITH {_ORDERS}, w AS (SELECT 2 * (quantile_cont(e, 0.75) - quantile_cont(e, 0.25)) * pow(count(*), -1 / 3.0) AS w, min(e) AS lo FROM r),
    o AS (SELECT w, (floor(lo / w - 0.5) + 0.5) * w AS origin FROM w)
    SELECT CAST(greatest(ceil((e - origin) / w) - 1, 0) AS INTEGER) AS bin, count(*) AS n FROM r, o GROUP BY 1"""
)
def gam_line_residual_histogram(spark, d):
    rows, model = _orders_line(spark, d)
    return check.residual_histogram(model, rows).select("bin", "n")


# --- group means of every family ---

_FAMILIES = ("gamma", "inverse_gaussian", "tweedie", "gaussian")


def _groups(spark, d, family):
    rows = table(spark, d, "lineitem")
    indicator = linear("CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END")
    return rows, gam(rows, "l_quantity", [indicator], family=family, power=1.4, lam=0.0)


@query(
    "SELECT family, status, round(fitted, 6) AS fitted, n FROM (SELECT l_linestatus AS status, avg(l_quantity) AS fitted,"
    f" count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest({list(_FAMILIES)}) AS family)"
)
def gam_group_means(spark, d):
    """With one indicator and no penalty, every family's fit is the mean of each group."""
    out = []
    for family in _FAMILIES:
        rows, model = _groups(spark, d, family)
        made = model.predict(rows, scale="response", se=False)
        out.append(
            made.groupBy(F.lit(family).alias("family"), F.col("l_linestatus").alias("status")).agg(
                F.avg("fit").alias("fitted"), F.count("fit").alias("n")
            )
        )
    return rounded(bind_rows(*out))


def _family_sql(name, unit, null_unit, variance, loglik):
    return f"""SELECT '{name}' AS family, round(sum({unit}), 3) AS deviance, round(1 - sum({unit}) / sum({null_unit}), 9) AS deviance_explained,
    round(sum((y - m) * (y - m) / ({variance})) / (count(*) - 2), 6) AS scale, {loglik} AS aic FROM g"""


def _gamma_unit(m):
    return f"2 * ((y - {m}) / {m} - ln(y / {m}))"


def _ig_unit(m):
    return f"(y - {m}) * (y - {m}) / ({m} * {m} * y)"


def _tweedie_unit(m):
    return f"2 * (pow(y, 0.6) / (-0.4 * 0.6) - y * pow({m}, -0.4) / -0.4 + pow({m}, 0.6) / 0.6)"


_SHAPE = f"(count(*) / sum({_gamma_unit('m')}))"


@query(
    """WITH g AS (SELECT l_quantity AS y, avg(l_quantity) OVER (PARTITION BY l_linestatus) AS m, avg(l_quantity) OVER () AS m0 FROM lineitem) """
    + " UNION ALL ".join(
        [
            _family_sql(
                "gamma", _gamma_unit("m"), _gamma_unit("m0"), "m * m",
                f"round(6 - 2 * (({_SHAPE} - 1) * sum(ln(y)) - {_SHAPE} * sum(y / m) - {_SHAPE} * sum(ln(m))"
                f" + count(*) * ({_SHAPE} * ln({_SHAPE}) - lgamma({_SHAPE}))), 3)",
            ),
            _family_sql(
                "inverse_gaussian", _ig_unit("m"), _ig_unit("m0"), "m * m * m",
                f"round(6 + count(*) * (ln(2 * pi() * sum({_ig_unit('m')}) / count(*)) + 1) + 3 * sum(ln(y)), 3)",
            ),
            _family_sql("tweedie", _tweedie_unit("m"), _tweedie_unit("m0"), "pow(m, 1.4)", "CAST(NULL AS DOUBLE)"),
        ]
    )
)
def gam_family_statistics(spark, d):
    """Deviance, dispersion and AIC of the log-link families (the Tweedie density has no closed form)."""
    out = []
    for family in _FAMILIES[:3]:
        stat = _groups(spark, d, family)[1].statistics()
        aic = F.lit(None).cast("double") if family == "tweedie" else F.round("aic", 3)
        out.append(
            stat.select(
                "family",
                F.round("deviance", 3).alias("deviance"),
                F.round("deviance_explained", 9).alias("deviance_explained"),
                F.round("scale", 6).alias("scale"),
                aic.alias("aic"),
            )
        )
    return bind_rows(*out)


# --- a group effect with a given penalty ---


@query(
    """WITH g AS (SELECT l_returnflag AS flag, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
    p AS (SELECT 0.5 * sqrt(sum(n * n) / 3.0) AS lam FROM g),
    a AS (SELECT sum(n * lam / (n + lam) * m) / sum(n * lam / (n + lam)) AS a FROM g, p)
    SELECT flag, round(n * (m - a) / (n + lam), 6) AS effect, round(a, 6) AS "constant" FROM g, p, a"""
)
def gam_penalised_groups(spark, d):
    """Group effects shrunk by half the size of their cross-products."""
    rows = table(spark, d, "lineitem")
    model = gam(rows, "l_quantity", [re("l_returnflag")], lam=0.5)
    made = model.predict_terms(rows.select("l_returnflag"), "s(l_returnflag)").distinct()
    return rounded(made.select(F.col("l_returnflag").alias("flag"), "effect", "constant"))
