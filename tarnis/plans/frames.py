"""Model frames: the cleaned daily table with nutrients, climate and short names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnis.functions.columns import parse_date, row_sum
from tarnis.operators.filters import complete_cases, in_years, nonzero
from tarnis.operators.frame import half_detection_limit, rename, with_calendar
from tarnis.operators.joins import merge_inner

# Short names of the model frame; the second table only where present.
SHORT_NAMES = {
    "Date": "date",
    "Chla_ug.L": "chla",
    "NO3_mg.L": "NO3",
    "NH3_mg.L": "NH3",
    "SRP_ug.L": "SRP",
    "Temp_C": "W_temp",
    "SK05JG006.cms": "QLD",
    "RC_IC_cms": "QWS",
}
OPTIONAL_NAMES = {
    "Odour_TON": "TON",
    "Turb_NTU": "turb",
    "TP_ug.L": "TP",
    "Cond_uS.cm": "cond",
    "SO4_mg.L": "SO4",
    "combined_05JG004.cms": "QBP",
    "Org_N_mg.L": "orgN",
}


def short_names(df: DataFrame) -> DataFrame:
    present = {old: new for old, new in OPTIONAL_NAMES.items() if old in df.columns}
    return rename(df, SHORT_NAMES | present)


def predictor_frame(table: DataFrame, climate: DataFrame) -> DataFrame:
    """Frame of the final model: days with chlorophyll, non-detects at half the detection limit,
    dissolved nitrogen, and the day's climate indices."""
    df = short_names(table.withColumn("Date", parse_date("Date")))
    df = half_detection_limit(complete_cases(df, ["chla"]))
    df = df.withColumn("DIN", row_sum(["NO3", "NH3"]))
    return merge_inner(df, climate, ["date"])


def fitting_frame(table: DataFrame, lagged_climate: DataFrame, first: int = 1984, last: int = 2022) -> DataFrame:
    """Frame of the model search: calendar columns, lagged indices, and no zeros."""
    df = table.withColumn("Date", parse_date("Date"))
    df = in_years(with_calendar(df, "Date"), "Date", first, last)
    df = complete_cases(short_names(df), ["chla"])
    df = df.withColumn("DIN", row_sum(["NO3", "NH3"]))
    return nonzero(merge_inner(df, lagged_climate, ["date"]), ["chla", "SRP", "DIN"])


def season_frame(table: DataFrame) -> DataFrame:
    """Frame of the year and season model: dated, non-zero chlorophyll."""
    df = rename(table.withColumn("Date", parse_date("Date")), {"Date": "date", "Chla_ug.L": "chla"})
    return nonzero(complete_cases(df, ["chla"]), ["chla"])
