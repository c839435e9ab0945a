"""Monthly climate indices: smoothed, expanded to days, and summed up by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import MONTHS, date_of, month_number, shift_months
from tarnis.operators.filters import in_years
from tarnis.operators.frame import with_phase
from tarnis.operators.joins import expand_months, merge_inner
from tarnis.operators.reshape import to_long
from tarnis.operators.series import centered_mean
from tarnis.operators.summary import annual_index


def monthly_index(matrix: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Year x month table to (Date, <name>, <name>_3MON_AVG), one row per month.

    A series has 12 rows a year, so its window is small.
    """
    long = to_long(matrix, [*by, "Year"], list(MONTHS), "month", name)
    dated = long.withColumn("Date", date_of("Year", month_number("month")))
    smooth = centered_mean(dated, name, "Date", 3, by, f"{name}_3MON_AVG", bounded=True)
    return smooth.select(*by, "Date", name, f"{name}_3MON_AVG")


def daily_index(monthly: DataFrame, name: str, shift: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Each month's values on each of its days; `shift` moves the months (negative = back)."""
    if shift:
        monthly = monthly.withColumn("Date", shift_months("Date", shift))
    daily = expand_months(monthly, "Date", [*by, f"{name}_3MON_AVG", name])
    return daily.withColumnRenamed(name, name.lower())


def climate_daily(pdo: DataFrame, soi: DataFrame, shift: int = 0) -> DataFrame:
    """(date, PDO_3MON_AVG, pdo, SOI_3MON_AVG, soi) for the days both indices cover."""
    p = daily_index(monthly_index(pdo, "PDO"), "PDO", shift)
    s = daily_index(monthly_index(soi, "SOI"), "SOI", shift)
    return merge_inner(p, s, ["date"])


def climate_annual(daily: DataFrame, first: int = 1984, last: int = 2022) -> DataFrame:
    """Annual means of the smoothed indices with their phase labels; an incomplete year is NULL."""
    kept = in_years(daily, "date", first, last)
    annual = annual_index(kept, "date", {"PDO": "PDO_3MON_AVG", "SOI": "SOI_3MON_AVG"})
    return with_phase(annual)
