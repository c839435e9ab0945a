"""Whole preparation jobs on tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.joins_series import phase_values
from catalog.registry import query, rounded, table
from tarnis.functions.columns import MONTHS
from tarnis.plans import climate, flow_sources, flows, frames, lab, timeline
from tarnis.session import scratch_path
from tarnis.sources import files
from tarnis.sources.phases import PDO_PHASES, phase_table

# --- daily flow --------------------------------------------------------------------------------

_RAW_FLOW = """(SELECT l_shipdate::DATE AS date,
    sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n,
    sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS t, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r,
    sum(CASE WHEN l_linenumber = 7 THEN l_quantity ELSE 0 END) AS u FROM lineitem GROUP BY 1)"""


def raw_flow(spark, d):
    """Daily sums of the line items, written as a text flow file and read back; one gauge has
    unreadable cells."""
    q = F.col("l_quantity")
    when = {
        "SK05JG013.cms": F.col("l_returnflag") == "A",
        "combined_05JG014.cms": F.col("l_returnflag") == "N",
        "combined_05JG004.cms": F.col("l_linestatus") == "F",
        "SK05JG006.cms": F.col("l_returnflag") == "R",
        "predicted_Ungauged.cms": F.col("l_linenumber") == 7,
    }
    day = F.col("l_shipdate").cast("date")
    sums = table(spark, d, "lineitem").groupBy(day.alias("day")).agg(
        *[F.sum(F.when(c, q).otherwise(0.0)).cast("string").alias(n) for n, c in when.items()]
    )
    text = F.when(F.dayofmonth("day") == 13, "oops").otherwise(F.col("`SK05JG006.cms`"))
    rows = sums.withColumn("SK05JG006.cms", text).select(
        F.date_format("day", "M/d/yyyy").alias("date"), *[F.col(f"`{g}`") for g in flows.GAUGES]
    )
    path = scratch_path(spark, "flow-csv")
    files.write_table(rows, path, "csv")
    return files.read_table(spark, path, flows.FLOW_SCHEMA)


_DAILY_FLOW = f"""SELECT CAST(year(date) AS INTEGER) AS year, CAST(dayofyear(date) AS INTEGER) AS "DOY", date, a AS "SK05JG013.cms",
    n AS "combined_05JG014.cms", t AS "combined_05JG004.cms", CASE WHEN day(date) <> 13 THEN r END AS "SK05JG006.cms",
    u AS "predicted_Ungauged.cms", a + n AS "RC_IC_cms", round((a + n) / nullif(t, 0) * 100, 6) AS "RC_IC_percent",
    round((a + n + u) / nullif(t, 0) * 100, 6) AS "RC_IC_U_percent"
    FROM {_RAW_FLOW} WHERE date >= DATE '1996-01-01' AND date < DATE '2001-01-01'"""


def _rounded_flow(df):
    return df.withColumns({c: F.round(F.col(c), 6) for c in ("RC_IC_percent", "RC_IC_U_percent")})


@query(_DAILY_FLOW)
def daily_flow(spark, d):
    return _rounded_flow(flows.daily_flow(raw_flow(spark, d), 1996, 2000))


# --- laboratory --------------------------------------------------------------------------------

_NAMES = list(lab.PARAMETERS)


def raw_lab(spark, d):
    """Line items as a long laboratory table: line number = parameter, status F = station 'Raw'."""
    names = F.array(*[F.lit(p) for p in _NAMES])
    return table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("tbl_date_ymd"),
        names[F.col("l_linenumber") - 1].alias("tbl_parameter"),
        F.nullif("l_quantity", F.lit(50)).alias("tbl_result"),
        F.when(F.col("l_linestatus") == "F", "Raw").otherwise("Treated").alias("tbl_station"),
        F.year("l_shipdate").alias("tbl_sheet_year"),
    )


def patch_2001(spark, d):
    names = F.array(*[F.lit(p) for p in _NAMES])
    day = F.col("l_shipdate").cast("date")
    rows = table(spark, d, "lineitem").where((F.year("l_shipdate") == 2001) & (F.col("l_linestatus") == "O"))
    return rows.select(
        names[F.col("l_linenumber") - 1].alias("parameter"), day.alias("date_ymd"), F.year(day).alias("year"),
        F.col("l_quantity").alias("result"),
    )


def _cell(number: int) -> str:
    x = f"CASE WHEN p = {number} THEN x END"
    return f"CASE WHEN count({x}) = count(*) FILTER (p = {number}) THEN avg({x}) END"


_LAB_WIDE = f"""(SELECT date, CAST(year(date) AS INTEGER) AS year, {", ".join(f'{_cell(i + 1)} AS "{c}"' for i, c in enumerate(lab.PARAMETERS.values()))}
    FROM (SELECT l_shipdate::DATE AS date, l_linenumber AS p, nullif(l_quantity, 50) AS x FROM lineitem
          WHERE l_linestatus = 'F' AND year(l_shipdate) <> 2001
          UNION ALL SELECT l_shipdate::DATE, l_linenumber, l_quantity FROM lineitem
          WHERE l_linestatus = 'O' AND year(l_shipdate) = 2001) GROUP BY 1, 2)"""


def _nulls(columns) -> str:
    return " + ".join(f'("{c}" IS NULL)::INT' for c in columns)


_LAB_COLUMNS = list(lab.PARAMETERS.values())
_CLEAN_LAB = f"""(SELECT date AS "Date", year, {", ".join(f'"{c}"' for c in _LAB_COLUMNS)}, "combined_05JG004.cms", "SK05JG006.cms", "RC_IC_cms",
    CAST(dayofyear(date) AS INTEGER) AS "DOY", CAST(month(date) AS INTEGER) AS "nMonth"
    FROM (SELECT l.*, f."combined_05JG004.cms", f."SK05JG006.cms", f."RC_IC_cms" FROM
        (SELECT * FROM {_LAB_WIDE} WHERE {_nulls(_LAB_COLUMNS)} <= 5) l LEFT JOIN ({_DAILY_FLOW}) f ON l.date = f.date)
    WHERE {_nulls([*_LAB_COLUMNS, *lab.FLOW_COLUMNS])} <= 7)"""


def _clean_lab(spark, d):
    flow = flows.daily_flow(raw_flow(spark, d), 1996, 2000)
    return lab.clean_lab(raw_lab(spark, d), flow, patch_2001(spark, d))


@query(f"SELECT * FROM {_CLEAN_LAB}")
def clean_lab(spark, d):
    return _clean_lab(spark, d)


# --- climate -----------------------------------------------------------------------------------


def month_matrix(spark, d, name, date, value, centre):
    """Year x month table of monthly means of whole-number values about a centre."""
    x = F.col(value)
    return table(spark, d, name).groupBy(F.year(date).alias("Year")).agg(
        *[(F.avg(F.when(F.month(date) == i, x)) - centre).alias(m) for i, m in enumerate(MONTHS, 1)]
    )


def _climate(spark, d, shift=0):
    pdo = month_matrix(spark, d, "lineitem", "l_shipdate", "l_quantity", 25.5)
    soi = month_matrix(spark, d, "orders", "o_orderdate", "o_custkey", 750.0)
    return climate.climate_daily(pdo, soi, shift)


def _index_sql(name, date, value, centre):
    return f"""(SELECT month, x, CASE WHEN count(x) OVER w = 3 THEN avg(x) OVER w END AS x3 FROM
        (SELECT make_date(y, m, 1) AS month, x FROM (SELECT DISTINCT year({date}) AS y FROM {name}) CROSS JOIN (SELECT unnest(range(1, 13)) AS m)
         LEFT JOIN (SELECT year({date}) AS y, month({date}) AS m, avg({value}) - {centre} AS x FROM {name} GROUP BY 1, 2) USING (y, m))
        WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def _climate_sql(shift: int = 0):
    months = """SELECT unnest(generate_series(start, start + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date, x, x3
        FROM (SELECT (month + INTERVAL ({s}) MONTH)::DATE AS start, x, x3 FROM {index})"""
    p = months.format(s=shift, index=_index_sql("lineitem", "l_shipdate", "l_quantity", 25.5))
    s = months.format(s=shift, index=_index_sql("orders", "o_orderdate", "o_custkey", "750.0"))
    return f"""(SELECT date, p.x3 AS "PDO_3MON_AVG", p.x AS pdo, s.x3 AS "SOI_3MON_AVG", s.x AS soi FROM ({p}) p JOIN ({s}) s USING (date))"""


_ROUND_CLIMATE = """round("PDO_3MON_AVG", 6) AS "PDO_3MON_AVG", round(pdo, 6) AS pdo, round("SOI_3MON_AVG", 6) AS "SOI_3MON_AVG", round(soi, 6) AS soi"""


@query(f"SELECT date, {_ROUND_CLIMATE} FROM {_climate_sql()}")
def climate_daily(spark, d):
    return rounded(_climate(spark, d))


@query(f"SELECT date, {_ROUND_CLIMATE} FROM {_climate_sql(-6)}")
def climate_daily_shifted(spark, d):
    return rounded(_climate(spark, d, -6))


@query(
    f"""SELECT "Year", round(p, 6) AS "PDO", round(s, 6) AS "SOI", CASE WHEN p IS NULL THEN NULL WHEN p < 0 THEN 'Wet' ELSE 'Dry' END AS "PDO_desc",
    CASE WHEN s IS NULL THEN NULL WHEN s > 0 THEN 'Cool_Wet' ELSE 'Warm_Dry' END AS "SOI_desc",
    CASE WHEN p < 0 AND s > 0 THEN 'Cool_wet' WHEN p > 0 AND s < 0 THEN 'Warm_dry' ELSE 'Other' END AS "Desc"
    FROM (SELECT CAST(year(date) AS INTEGER) AS "Year", CASE WHEN count("PDO_3MON_AVG") = count(*) THEN avg("PDO_3MON_AVG") END AS p,
        CASE WHEN count("SOI_3MON_AVG") = count(*) THEN avg("SOI_3MON_AVG") END AS s FROM {_climate_sql()} GROUP BY 1)"""
)
def annual_index_label(spark, d):
    return rounded(climate.climate_annual(_climate(spark, d)))


# --- model frames ------------------------------------------------------------------------------

_SHORT = """"Date" AS date, year, "Chla_ug.L" AS chla, {no3} AS "NO3", {nh3} AS "NH3", {srp} AS "SRP", "TP_ug.L" AS "TP", "Temp_C" AS "W_temp",
    "Org_N_mg.L" AS "orgN", "combined_05JG004.cms" AS "QBP", "SK05JG006.cms" AS "QLD", "RC_IC_cms" AS "QWS", "DOY", "nMonth" """


def _half(column, limit):
    return f'CASE WHEN "{column}" = 0 THEN {limit / 2} ELSE "{column}" END'


@query(
    f"""SELECT m.*, round(coalesce("NO3", 0) + coalesce("NH3", 0), 6) AS "DIN", {_ROUND_CLIMATE} FROM
    (SELECT {_SHORT.format(no3=_half("NO3_mg.L", 0.057), nh3=_half("NH3_mg.L", 0.086), srp=_half("SRP_ug.L", 3.0))} FROM {_CLEAN_LAB}
     WHERE "Chla_ug.L" IS NOT NULL) m JOIN {_climate_sql()} c ON m.date = c.date"""
)
def model_frame_predictors(spark, d):
    out = frames.predictor_frame(_clean_lab(spark, d), _climate(spark, d))
    return rounded(out, 6, ["DIN", "PDO_3MON_AVG", "pdo", "SOI_3MON_AVG", "soi"])


@query(
    f"""SELECT * FROM (SELECT m.*, CAST(strftime(m.date, '%W') AS INTEGER) AS week, round(coalesce("NO3", 0) + coalesce("NH3", 0), 6) AS "DIN", {_ROUND_CLIMATE}
    FROM (SELECT {_SHORT.format(no3='"NO3_mg.L"', nh3='"NH3_mg.L"', srp='"SRP_ug.L"')} FROM {_CLEAN_LAB} WHERE "Chla_ug.L" IS NOT NULL) m
    JOIN {_climate_sql(-6)} c ON m.date = c.date) WHERE chla <> 0 AND "SRP" <> 0 AND "DIN" <> 0"""
)
def model_frame_fitting(spark, d):
    out = frames.fitting_frame(_clean_lab(spark, d), _climate(spark, d, -6))
    return rounded(out, 6, ["DIN", "PDO_3MON_AVG", "pdo", "SOI_3MON_AVG", "soi"])


# --- timeline, decades, flow sources -----------------------------------------------------------

_TIMELINE = {"quantity": "l_quantity", "discount": "nullif(l_discount, 0)", "tax": "nullif(l_tax, 0)", "price": "floor(l_extendedprice)"}


@query(
    "SELECT variable, year, mean, max, min, phase FROM ("
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, CAST(year(l_shipdate) AS INTEGER) AS year, round(avg({x}), 6) AS mean, max({x}) AS max, min({x}) AS min FROM lineitem GROUP BY 2"
        for v, x in _TIMELINE.items()
    )
    + f") LEFT JOIN {phase_values(PDO_PHASES)} ON year >= s AND year < e"
)
def annual_timeline(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_shipdate",
        F.col("l_quantity").alias("quantity"),
        F.nullif("l_discount", F.lit(0)).alias("discount"),
        F.nullif("l_tax", F.lit(0)).alias("tax"),
        F.floor("l_extendedprice").alias("price"),
    )
    out = timeline.annual_timeline(df, list(_TIMELINE), "l_shipdate", phase_table(spark, PDO_PHASES))
    return rounded(out, 6, ["mean"])


@query(
    """WITH a AS (SELECT o_orderstatus AS site, avg(o_custkey) AS x, median(o_orderdate) AS m FROM orders GROUP BY 1, year(o_orderdate))
    SELECT site, CAST(floor(year(m) / 10) * 10 AS INTEGER)::VARCHAR || 's' AS decade, round(avg(x), 6) AS mean, count(*) AS years
    FROM a GROUP BY 1, 2"""
)
def decadal_temperature(spark, d):
    df = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "site")
    return rounded(timeline.decadal_temperature(df, "o_custkey", "o_orderdate", "mean", by=["site"]))


@query(
    f"""WITH f AS ({_DAILY_FLOW}) SELECT '(Intercept)' AS term, round(regr_intercept("SK05JG006.cms", "RC_IC_cms"), 6) AS estimate FROM f
    UNION ALL SELECT 'QWS', round(regr_slope("SK05JG006.cms", "RC_IC_cms"), 6) FROM f"""
)
def flow_source_regression(spark, d):
    flow = flows.daily_flow(raw_flow(spark, d), 1996, 2000)
    flow = flow.select(F.col("`SK05JG006.cms`").alias("QLD"), F.col("RC_IC_cms").alias("QWS"))
    report = flow_sources.compare_sources(flow, reports=["coefficients"])
    return report["coefficients"].select("term", F.round("estimate", 6).alias("estimate"))


@query(
    f"""WITH f AS (SELECT "SK05JG006.cms" AS y, "RC_IC_cms" AS x FROM ({_DAILY_FLOW}) WHERE "SK05JG006.cms" IS NOT NULL)
    SELECT 'correlation' AS report, round(corr(x, y), 6) AS a, CAST(NULL AS DOUBLE) AS b FROM f
    UNION ALL SELECT 'quartiles', quantile_cont(x, 0.25), quantile_cont(x, 0.75) FROM f
    UNION ALL SELECT 'fit', round(regr_r2(y, x), 6), count(*)::DOUBLE FROM f"""
)
def flow_source_report(spark, d):
    flow = flows.daily_flow(raw_flow(spark, d), 1996, 2000)
    flow = flow.select(F.col("`SK05JG006.cms`").alias("QLD"), F.col("RC_IC_cms").alias("QWS"))
    made = flow_sources.compare_sources(flow, reports=["correlation", "quartiles", "fit"])
    rows = [
        made["correlation"].select(F.lit("correlation"), F.round("corr", 6), F.lit(None).cast("double")),
        made["quartiles"].select(F.lit("quartiles"), "q1", "q3"),
        made["fit"].select(F.lit("fit"), F.round("r2", 6), F.col("n").cast("double")),
    ]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).toDF("report", "a", "b")
