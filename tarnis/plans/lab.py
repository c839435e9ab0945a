"""Laboratory results: long table to one row per sampling day, joined with flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnis.functions.columns import col, serial_to_date
from tarnis.operators.filters import exclude_year, max_nulls, select_parameters
from tarnis.operators.frame import rename, strip_prefix
from tarnis.operators.joins import merge_left, merge_outer
from tarnis.operators.reshape import bind_rows, to_long, to_wide

# Laboratory parameters and the columns they become.
PARAMETERS = {
    "Chlorophyll a": "Chla_ug.L",
    "Nitrate": "NO3_mg.L",
    "Ammonia N": "NH3_mg.L",
    "Phosphate (ortho)": "SRP_ug.L",
    "Phosphate (total)": "TP_ug.L",
    "Temperature": "Temp_C",
    "Organic N": "Org_N_mg.L",
}
STATION = "Raw"
PATCHED_YEAR = 2001
MAX_NULLS_LAB, MAX_NULLS_MERGED = 5, 7
FLOW_COLUMNS = ("combined_05JG004.cms", "SK05JG006.cms", "RC_IC_cms")

LAB_SCHEMA = T.StructType(
    [
        T.StructField("tbl_date_ymd", T.DateType()),
        T.StructField("tbl_parameter", T.StringType()),
        T.StructField("tbl_result", T.DoubleType()),
        T.StructField("tbl_station", T.StringType()),
        T.StructField("tbl_sheet_year", T.IntegerType()),
    ]
)


def lab_long(lab: DataFrame, station: str = STATION, first: int = 1984, last: int = 2022) -> DataFrame:
    """Results of one station and the known parameters: (date_ymd, parameter, result, year)."""
    df = lab.select("tbl_date_ymd", "tbl_parameter", "tbl_result", "tbl_station", "tbl_sheet_year")
    df = select_parameters(df, station, list(PARAMETERS), "tbl_station", "tbl_parameter")
    df = df.where(F.col("tbl_sheet_year").between(first, last))
    df = strip_prefix(rename(df, {"tbl_sheet_year": "year"}), "tbl_")
    return df.drop("station")


def block_long(block: DataFrame, ids: Sequence[str] = ("Parameters", "Units")) -> DataFrame:
    """Sheet block with one column per spreadsheet date to (parameter, date_ymd, year, result)."""
    block = block.where(col("Parameters").isin(*PARAMETERS)).drop("file", "line")
    dates = [c for c in block.columns if c not in ids]
    long = to_long(block, list(ids), dates, "date_ymd", "result")
    day = serial_to_date("date_ymd")
    return long.select(
        F.col("Parameters").alias("parameter"),
        day.alias("date_ymd"),
        F.year(day).alias("year"),
        F.col("result").try_cast("double").alias("result"),
    )


def lab_wide(lab: DataFrame, patch: DataFrame | None = None, year: int = PATCHED_YEAR) -> DataFrame:
    """One row per date and year, one column per parameter; `patch` replaces the rows of one year."""
    if patch is not None:
        lab = bind_rows(exclude_year(lab, year), patch)
    wide = to_wide(lab, ["date_ymd", "year"], "parameter", "result", PARAMETERS)
    return wide.withColumnRenamed("date_ymd", "Date")


def clean_lab(lab: DataFrame, flow: DataFrame, patch: DataFrame | None = None,
              k_lab: int = MAX_NULLS_LAB, k_merged: int = MAX_NULLS_MERGED) -> DataFrame:
    """Sampling days with at most k_lab missing values, joined with the day's flow, again limited
    to k_merged missing values, with calendar columns.

    A day with flow but no sample has as many missing values as the lab table has columns beside
    the date; when that exceeds k_merged such days can never stay, so they are not brought in.
    """
    wide = max_nulls(lab_wide(lab_long(lab), patch), k_lab)
    flow = flow.select(F.col("date").alias("Date"), *[col(c) for c in FLOW_COLUMNS])
    flow_only_nulls = len(wide.columns) - 1
    merge = merge_left if k_merged < flow_only_nulls else merge_outer
    dated = wide.where(F.col("Date").isNotNull())
    merged = max_nulls(merge(dated, flow, ["Date"]), k_merged)
    return merged.withColumns({"DOY": F.dayofyear("Date"), "nMonth": F.month("Date")})
