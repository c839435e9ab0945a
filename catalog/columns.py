"""Columns, filters, reshaping and sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.registry import query, rounded, table
from tarnis.functions import columns as c
from tarnis.operators import filters, frame, joins, order, reshape
from tarnis.session import scratch_path
from tarnis.sources import files

# --- projections and column algebra ------------------------------------------------------------


@query(
    """SELECT returnflag, count(*) AS n, sum(quantity) AS quantity FROM
    (SELECT l_returnflag AS returnflag, l_quantity AS quantity FROM lineitem) GROUP BY returnflag"""
)
def strip_prefix_select(spark, d):
    df = frame.strip_prefix(table(spark, d, "lineitem"), "l_")
    df = frame.select_columns(df, ["returnflag", "quantity"])
    return df.groupBy("returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query(
    """SELECT o_custkey AS site, count(*) AS n, max(o_totalprice) AS flow FROM orders GROUP BY o_custkey"""
)
def rename_columns(spark, d):
    df = frame.rename(table(spark, d, "orders"), {"o_custkey": "site", "o_totalprice": "flow"})
    return df.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.max("flow").alias("flow"))


@query(
    """SELECT l_orderkey, round(a + n, 6) AS creeks, round((a + n) / nullif(a + n + r, 0) * 100, 6) AS percent
    FROM (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a,
                 sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n,
                 sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r
          FROM lineitem GROUP BY l_orderkey)"""
)
def percent_contribution(spark, d):
    q = F.col("l_quantity")
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f.upper(), q).otherwise(0.0)).alias(f) for f in "anr"]
    )
    df = frame.add_sum(frame.add_sum(parts, "total", ["a", "n", "r"]), "creeks", ["a", "n"])
    df = frame.percent_of(df, ["a", "n"], "total", "percent")
    return rounded(df.select("l_orderkey", "creeks", "percent"))


@query(
    """SELECT kind, count(*) AS n, count(number) AS numeric_n, sum(number) AS total FROM
    (SELECT o_orderstatus AS kind, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'oops' ELSE
        CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS number FROM orders) GROUP BY kind"""
)
def numeric_text(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", "oops").otherwise(F.col("o_custkey").cast("string"))
    df = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), text.alias("number"))
    df = frame.numeric_cols(df, ["number"])
    return df.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("number").alias("numeric_n"), F.sum("number").alias("total")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date
    FROM orders"""
)
def parse_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "M/d/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy-MM-dd"))
        .otherwise("not a date")
    )
    df = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return df.select("o_orderkey", c.parse_date("text").alias("date"))


@query(
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
    CAST(dayofyear(o_orderdate) AS INTEGER) AS "DOY", CAST(month(o_orderdate) AS INTEGER) AS "nMonth",
    CAST(strftime(o_orderdate, '%W') AS INTEGER) AS week FROM orders"""
)
def calendar_parts(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return frame.with_calendar(days)


@query(
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%d-%m-%Y') AS label,
    month(o_orderdate)::INTEGER AS month, make_date(year(o_orderdate), month(o_orderdate), 1) AS month_start
    FROM orders"""
)
def decimal_years(spark, d):
    day = F.col("o_orderdate").cast("date")
    length = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    decimal = F.year(day) + (F.dayofyear(day) - 0.5) / length
    df = table(spark, d, "orders").select(decimal.alias("y"), F.date_format(day, "MMM").alias("m")).distinct()
    back, month = c.decimal_year_to_date("y"), c.month_number("m")
    df = df.select(back.alias("date"), c.day_month_year(back).alias("label"), month.alias("month"))
    return df.withColumn("month_start", c.date_of(F.year("date"), "month"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_discount = 0 THEN 0.0285 ELSE l_discount END AS "NO3",
    CASE WHEN nullif(l_tax, 0.08) = 0 THEN 0.043 ELSE nullif(l_tax, 0.08) END AS "NH3",
    round(CASE WHEN l_discount = 0 THEN 0.0285 ELSE l_discount END +
        coalesce(CASE WHEN nullif(l_tax, 0.08) = 0 THEN 0.043 ELSE nullif(l_tax, 0.08) END, 0), 6) AS "DIN"
    FROM lineitem"""
)
def half_detection_limit(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_discount").alias("NO3"), F.nullif("l_tax", F.lit(0.08)).alias("NH3"),
    )
    limits = {k: c.DETECTION_LIMITS[k] for k in ("NO3", "NH3")}
    df = frame.half_detection_limit(df, limits)
    return rounded(df.withColumn("DIN", c.row_sum(["NO3", "NH3"])), 6, ["DIN"])


@query(
    """SELECT l_shipdate::DATE AS date, count(*) AS n, round(sum(coalesce(a, 0) + coalesce(b, 0)), 6) AS sum_zero,
    count(coalesce(a, b)) AS n_known, sum((a IS NULL)::INT + (b IS NULL)::INT)::BIGINT AS nulls
    FROM (SELECT l_shipdate, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b FROM lineitem) GROUP BY 1"""
)
def row_sum_nulls(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.nullif("l_discount", F.lit(0)).alias("a"),
        F.nullif("l_tax", F.lit(0)).alias("b"),
    )
    df = df.withColumns(
        {
            "total": c.row_sum(["a", "b"]),
            "known": c.row_sum(["a", "b"], all_null_is_null=True),
            "missing": c.null_count(["a", "b"]),
        }
    )
    out = df.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total").alias("sum_zero"),
        F.count("known").alias("n_known"),
        F.sum("missing").alias("nulls"),
    )
    return rounded(out)


@query(
    """SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root,
    round(exp(ln(o_totalprice) / 2), 6) AS back, CAST(o_custkey AS VARCHAR) AS site FROM orders"""
)
def transforms(spark, d):
    df = table(spark, d, "orders")
    out = df.select(
        "o_orderkey",
        c.signed_sqrt_guard("o_totalprice").alias("root"),
        F.exp(F.ln("o_totalprice") / 2).alias("back"),
        c.as_category("o_custkey").alias("site"),
    )
    return rounded(out)


@query(
    """SELECT year, mean, round(mean - 1.96 * se, 6) AS lower, round(mean + 1.96 * se, 6) AS upper FROM
    (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) AS mean,
        stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1)"""
)
def confidence_interval(spark, d):
    q = F.col("l_quantity")
    df = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.avg(q).alias("mean"), (F.stddev_samp(q) / F.sqrt(F.count(q))).alias("se")
    )
    return rounded(frame.with_ci(df, "mean", "se").drop("se"), 6, ["lower", "upper"])


@query(
    """SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size,
    round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice
    FROM part"""
)
def zscore(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice")
    return rounded(frame.zscore(df, ["p_size", "p_retailprice"]))


@query(
    """SELECT p_partkey, p_brand, round((p_retailprice - avg(p_retailprice) OVER w) / stddev_samp(p_retailprice) OVER w, 6)
    AS p_retailprice FROM part WINDOW w AS (PARTITION BY p_brand)"""
)
def zscore_by_group(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(frame.zscore(df, ["p_retailprice"], ["p_brand"]))


# --- filters -----------------------------------------------------------------------------------


@query(
    """SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders
    WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01' GROUP BY 1"""
)
def year_range(spark, d):
    df = filters.in_years(table(spark, d, "orders"), "o_orderdate", 1996, 1998)
    return df.groupBy(F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean FROM lineitem
    WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') GROUP BY 1"""
)
def select_parameters(spark, d):
    df = filters.select_parameters(
        table(spark, d, "lineitem"), "F", ["A", "R"], "l_linestatus", "l_returnflag"
    )
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"))


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders
    WHERE CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END <> 1997 GROUP BY 1"""
)
def excluded_years(spark, d):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    df = filters.exclude_year(table(spark, d, "orders").withColumn("year", year), 1997)
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def _measures(spark, d):
    return table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.nullif("l_discount", F.lit(0)).alias("a"),
        F.nullif("l_tax", F.lit(0)).alias("b"),
        F.nullif("l_quantity", F.lit(1)).alias("c"),
    )


_MEASURES = """(SELECT CAST(year(l_shipdate) AS INTEGER) AS year, nullif(l_discount, 0) AS a,
    nullif(l_tax, 0) AS b, nullif(l_quantity, 1) AS c FROM lineitem)"""


@query(f"SELECT year, count(*) AS n FROM {_MEASURES} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY year")
def complete_cases(spark, d):
    df = filters.complete_cases(_measures(spark, d), ["a", "b"])
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT year, count(*) AS n FROM {_MEASURES}
    WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT <= 1 GROUP BY year"""
)
def max_nulls(spark, d):
    df = filters.max_nulls(_measures(spark, d), 1, ["a", "b", "c"])
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0 GROUP BY 1"""
)
def nonzero(spark, d):
    df = filters.nonzero(table(spark, d, "lineitem"), ["l_discount", "l_tax"])
    return df.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    """SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderdate > DATE '1996-06-30' AND o_orderdate < DATE '1999-07-01' GROUP BY 1"""
)
def date_window(spark, d):
    df = filters.between_dates(
        table(spark, d, "orders"), "o_orderdate", dt.date(1996, 6, 30), dt.date(1999, 7, 1), open_start=True
    )
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE AS date FROM orders ORDER BY date, o_orderkey")
def sort_by_date(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return order.sort_by_date(df, "date", "o_orderkey")


# --- union and reshaping -----------------------------------------------------------------------


@query(
    """SELECT source, count(*) AS n, count(status) AS with_status FROM
    (SELECT 'orders' AS source, o_orderstatus AS status FROM orders
     UNION ALL SELECT 'lineitem', NULL FROM lineitem) GROUP BY source"""
)
def bind_rows(spark, d):
    a = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderstatus").alias("status"))
    b = table(spark, d, "lineitem").select(F.lit("lineitem").alias("source"))
    return reshape.bind_rows(a, b).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("status").alias("with_status")
    )


@query(
    """SELECT o_orderkey, o_orderdate::DATE AS date, o_totalprice FROM orders WHERE year(o_orderdate) <> 1998
    UNION ALL SELECT o_orderkey + 1000000000, o_orderdate::DATE, round(o_totalprice * 2, 2) FROM orders
    WHERE year(o_orderdate) = 1998"""
)
def replace_slice(spark, d):
    base = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice"
    )
    in_1998 = F.year("date") == 1998
    patch = base.where(in_1998).withColumns(
        {"o_orderkey": F.col("o_orderkey") + 1000000000, "o_totalprice": F.round(F.col("o_totalprice") * 2, 2)}
    )
    return reshape.replace_slice(base, patch, in_1998)


@query(
    """SELECT o_orderkey, 'price' AS name, o_totalprice AS value FROM orders UNION ALL
    SELECT o_orderkey, 'customer', nullif(CAST(o_custkey AS DOUBLE), 0) FROM orders"""
)
def wide_to_long(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.nullif(F.col("o_custkey").cast("double"), F.lit(0.0)).alias("customer"),
    )
    return reshape.to_long(df, ["o_orderkey"], ["price", "customer"])


def _strict(flag: str) -> str:
    x = f"CASE WHEN l_returnflag = '{flag}' THEN x END"
    return f"CASE WHEN count({x}) = count(*) FILTER (l_returnflag = '{flag}') THEN round(avg({x}), 9) END"


_DAILY_WIDE = f"""SELECT l_shipdate::DATE AS date, {_strict("A")} AS a, {_strict("N")} AS n, {_strict("R")} AS r
    FROM (SELECT *, nullif(l_discount, 0.1) AS x FROM lineitem) GROUP BY 1"""


def _daily_wide(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), "l_returnflag", F.nullif("l_discount", F.lit(0.1)).alias("x")
    )
    return reshape.to_wide(df, ["date"], "l_returnflag", "x", {"A": "a", "N": "n", "R": "r"})


@query(_DAILY_WIDE)
def daily_wide(spark, d):
    return rounded(_daily_wide(spark, d), 9)


@query(
    """SELECT CAST(ts AS DATE) AS date, max(value) FILTER (event_type = 'view') AS view,
    max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1"""
)
def daily_wide_max(spark, d):
    df = table(spark, d, "events").select(F.col("ts").cast("date").alias("date"), "event_type", "value")
    return reshape.to_wide(df, ["date"], "event_type", "value", ["view", "error"], F.max)


@query(
    f"""SELECT * FROM (SELECT date, a, n, r, orders, (a IS NULL)::INT + (n IS NULL)::INT + (r IS NULL)::INT
        + (orders IS NULL)::INT AS missing
      FROM ({_DAILY_WIDE}) FULL JOIN (SELECT o_orderdate::DATE AS date, count(*) AS orders FROM orders GROUP BY 1)
      USING (date)) WHERE missing <= 2"""
)
def null_threshold_merge(spark, d):
    days = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    merged = joins.merge_outer(rounded(_daily_wide(spark, d), 9), days, ["date"])
    values = ["a", "n", "r", "orders"]
    kept = filters.max_nulls(merged, 2, values)
    return kept.withColumn("missing", c.null_count(values))


# --- sources and sinks -------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate::DATE AS date, nullif(o_totalprice, 0) AS price, o_orderpriority FROM orders")
def delimited_source(spark, d):
    path = scratch_path(spark, "orders-csv")
    out = table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "M/d/yyyy").alias("date"),
        F.nullif("o_totalprice", F.lit(0.0)).alias("price"),
        "o_orderpriority",
    )
    files.write_table(out, path, "csv")
    schema = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("date", T.StringType()),
            T.StructField("price", T.DoubleType()),
            T.StructField("o_orderpriority", T.StringType()),
        ]
    )
    return files.read_table(spark, path, schema).withColumn("date", c.parse_date("date"))


@query(
    """SELECT CAST(y AS INTEGER) AS "Year", m AS month, CASE WHEN m = 2 THEN NULL ELSE n END AS value FROM
    (SELECT y, m, count(o_orderkey)::DOUBLE AS n FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)
     CROSS JOIN (SELECT unnest(range(1, 13))::INTEGER AS m)
     LEFT JOIN orders ON year(o_orderdate) = y AND month(o_orderdate) = m GROUP BY y, m)
    WHERE n > 0 OR m = 2"""
)
def month_matrix_source(spark, d):
    """Order counts per month written as a year x month text file (February as a missing mark), read
    back and laid out long."""
    path = scratch_path(spark, "months")
    counts = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        *[F.count_if(F.month("o_orderdate") == m).alias(f"m{m}") for m in range(1, 13)]
    )
    cells = [F.lit("99.99") if m == 2 else F.col(f"m{m}").cast("string") for m in range(1, 13)]
    counts.select(F.concat_ws("   ", F.col("y").cast("string"), *cells)).write.text(path)
    matrix = files.read_month_matrix(spark, path, sentinels=[99.99])
    long = reshape.to_long(matrix, ["Year"], list(c.MONTHS), "month", "value")
    long = long.withColumn("month", c.month_number("month"))
    return long.where(F.col("value").isNull() | (F.col("value") > 0))


@query(
    """SELECT p.parameter, d.date, CASE WHEN n IS NULL THEN 0 ELSE n END AS result
    FROM (SELECT DISTINCT o_orderpriority AS parameter FROM orders WHERE o_orderpriority <> '5-LOW') p
    CROSS JOIN (SELECT DISTINCT date_trunc('year', o_orderdate)::DATE AS date FROM orders) d
    LEFT JOIN (SELECT o_orderpriority AS parameter, date_trunc('year', o_orderdate)::DATE AS date,
        count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2) USING (parameter, date)"""
)
def block_source(spark, d):
    """Yearly order counts written as a sheet export (notes, header line 8, one column per
    spreadsheet date), read back as a block and typed."""
    path = scratch_path(spark, "block")
    years = list(range(1995, 2002))
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        *[F.count_if(F.year("o_orderdate") == y).alias(str(y)) for y in years]
    )
    serials = [str((dt.date(y, 1, 1) - dt.date(1899, 12, 30)).days) for y in years]
    line = F.concat_ws(",", "o_orderpriority", F.lit("n"), F.lit(""), F.lit(""), *[F.col(str(y)).cast("string") for y in years])
    header = ["note"] * 7 + [",".join(["Parameters", "Units", "", "", *serials])]
    body = counts.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"))
    body.select(F.concat(F.lit("\n".join(header) + "\n"), "b")).coalesce(1).write.text(path)
    names = files.block_header(spark, path)
    block = files.read_block(spark, path, names, header_row=8, last_row=67, drop=["...3", "...4"])
    block = block.where(F.col("Parameters") != "5-LOW").drop("file", "line")
    long = reshape.to_long(block, ["Parameters", "Units"], names[4:], "serial", "result")
    return long.select(
        F.col("Parameters").alias("parameter"),
        c.serial_to_date("serial").alias("date"),
        F.col("result").try_cast("double").alias("result"),
    )


@query(
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS site, count(*) AS n,
    sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2"""
)
def partitioned_sink(spark, d):
    path = scratch_path(spark, "partitioned")
    df = table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("site"), "l_quantity"
    )
    files.write_table(df, path, "parquet", ["site", "year"])
    stored = files.read_table(spark, path, "l_quantity double, site string, year int", fmt="parquet")
    return stored.groupBy("site", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    """SELECT "column", value, count(*) AS n FROM
    (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, TRY_CAST(o_orderpriority AS DOUBLE) IS NULL AS bad
       FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, TRY_CAST(o_orderstatus AS DATE) IS NULL FROM orders)
    WHERE bad AND value IS NOT NULL GROUP BY 1, 2"""
)
def parse_problems(spark, d):
    return files.parse_problems(table(spark, d, "orders"), {"o_orderpriority": "double", "o_orderstatus": "date"})
