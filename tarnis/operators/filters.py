"""Row filters. Predicates are written on raw columns so they reach the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import col, null_count


def in_years(df: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """Rows dated in the years first..last, as a range on the date itself (year(x) is not pushed)."""
    return between_dates(df, date, dt.date(first, 1, 1), dt.date(last + 1, 1, 1))


def between_dates(df: DataFrame, date: str, start=None, end=None, open_start: bool = False) -> DataFrame:
    """start <= date < end, either end optional; `open_start` leaves the start out."""
    d = col(date)
    if start is not None:
        df = df.where(d > F.lit(start) if open_start else d >= F.lit(start))
    if end is not None:
        df = df.where(d < F.lit(end))
    return df


def select_parameters(df: DataFrame, station: str, params: Sequence[str],
                      station_col: str = "station", param_col: str = "parameter") -> DataFrame:
    return df.where((col(station_col) == station) & col(param_col).isin(*params))


def exclude_year(df: DataFrame, year: int, year_col: str = "year") -> DataFrame:
    """All other years; rows without a year go too."""
    return df.where(col(year_col) != year)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every named column has a value (NaN is no value)."""
    kinds = dict(df.dtypes)
    for c in cols:
        df = df.where(col(c).isNotNull())
        if kinds[c] in ("double", "float"):
            df = df.where(~F.isnan(col(c)))
    return df


def max_nulls(df: DataFrame, k: int, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with at most k NULLs among `cols` (default: all columns)."""
    return df.where(null_count(df.columns if cols is None else cols) <= k)


def nonzero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every named column is neither 0 nor NULL."""
    for c in cols:
        df = df.where(col(c) != 0)
    return df
