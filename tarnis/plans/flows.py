"""Daily river flow preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnis.functions.columns import parse_date
from tarnis.operators.filters import in_years
from tarnis.operators.frame import add_sum, numeric_cols, percent_of, select_columns, with_calendar

# Column names of the raw flow file and the years kept.
GAUGES = (
    "SK05JG013.cms",
    "combined_05JG014.cms",
    "combined_05JG004.cms",
    "SK05JG006.cms",
    "predicted_Ungauged.cms",
)
FIRST_YEAR, LAST_YEAR = 1984, 2022

FLOW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("date", *GAUGES)])


def daily_flow(raw: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Typed daily flows with the combined creek flow and its share of the total, in percent.

    Row-wise throughout: no shuffle, whatever the number of stations.
    """
    creeks = ["SK05JG013.cms", "combined_05JG014.cms"]
    total = "combined_05JG004.cms"
    df = raw.withColumn("date", parse_date("date"))
    df = in_years(df, "date", first, last)
    df = numeric_cols(df, [c for c, kind in df.dtypes if kind == "string" and c in GAUGES])
    df = with_calendar(df).drop("nMonth", "week")
    df = add_sum(df, "RC_IC_cms", creeks)
    df = percent_of(df, creeks, total, "RC_IC_percent")
    df = percent_of(df, [*creeks, "predicted_Ungauged.cms"], total, "RC_IC_U_percent")
    return select_columns(df, ["year", "DOY", "date"], rest=True)
