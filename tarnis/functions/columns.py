"""Column expressions. All of them stay in the JVM and work on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month abbreviations as used in monthly index files.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Accepted date layouts, tried in this order.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd")

# Laboratory detection limits (nitrate and ammonia mg/L, phosphate ug/L).
DETECTION_LIMITS = {"NO3": 0.057, "NH3": 0.086, "SRP": 3.0}

# Fixed value: day 0 of spreadsheet serial dates.
SERIAL_ORIGIN = "1899-12-30"


def col(c: str | Column) -> Column:
    """Column by name, with dots in the name taken literally."""
    return F.col(f"`{c}`" if "." in c and "`" not in c else c) if isinstance(c, str) else c


def parse_date(c, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First layout that fits; text in no known layout becomes NULL. Typed dates pass through."""
    text = col(c).cast("string")
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def serial_to_date(c) -> Column:
    """Spreadsheet serial number (possibly text) to date; the time-of-day fraction is cut off."""
    return F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(col(c).try_cast("double")).cast("int"))


def week_of_year(c) -> Column:
    """Week 00-53, weeks start on Monday, days before the first Monday are week 0."""
    return F.floor((F.dayofyear(col(c)) + 6 - F.weekday(col(c))) / 7).cast("int")


def month_number(c) -> Column:
    """Month abbreviation to 1-12, NULL for anything else."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.nullif(F.array_position(names, col(c)), F.lit(0)).cast("int")


def date_of(year, month, day: int = 1) -> Column:
    """Date from year and month; an impossible month gives NULL."""
    m = col(month)
    return F.when(m.between(1, 12), F.make_date(col(year).cast("int"), m.cast("int"), F.lit(day)))


def shift_months(c, n: int) -> Column:
    """Move a date by n months (negative = back), clamped to the end of the target month.

    Shifting an index back by 6 months pairs each observation with the index of 6 months later.
    """
    return F.add_months(col(c), n)


def decimal_year_to_date(c) -> Column:
    """1992.5 -> the day half way through 1992."""
    y = F.floor(col(c)).cast("int")
    start, following = F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y + 1, F.lit(1), F.lit(1))
    days = F.datediff(following, start)
    return F.date_add(start, F.floor((col(c) - y) * days).cast("int"))


def day_month_year(c) -> Column:
    return F.date_format(col(c), "dd-MM-yyyy")


def row_sum(cols: Sequence, all_null_is_null: bool = False) -> Column:
    """Sum across columns that skips NULL. A row of NULLs gives 0, or NULL on request."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in cols])
    if not all_null_is_null:
        return total
    return F.when(F.coalesce(*[col(c) for c in cols]).isNotNull(), total)


def strict_sum(cols: Sequence) -> Column:
    """Sum across columns, NULL if any part is NULL."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def null_count(cols: Sequence) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNull().cast("int") for c in cols])


def half_limit(c, detection_limit: float) -> Column:
    """A reading of 0 means 'below the detection limit': put half the limit. NULL stays NULL."""
    return F.when(col(c) == 0, F.lit(detection_limit / 2)).otherwise(col(c))


def label_if(condition: Column, yes, no) -> Column:
    """Two-way label; unknown condition gives NULL (a plain CASE would give the second label)."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, F.lit(yes)).otherwise(F.lit(no))


def phase_label(pdo, soi) -> Column:
    """Joint climate phase; unknown values fall into 'Other'."""
    p, s = col(pdo), col(soi)
    return (
        F.when((p < 0) & (s > 0), "Cool_wet")
        .when((p > 0) & (s < 0), "Warm_dry")
        .otherwise("Other")
    )


def strict_mean(c) -> Column:
    """Aggregate: mean of the group, NULL if any value in it is NULL."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.avg(col(c)))


def as_category(c) -> Column:
    return col(c).cast("string")


def signed_sqrt_guard(c) -> Column:
    """Square root that gives NULL, not NaN, below zero."""
    return F.when(col(c) >= 0, F.sqrt(col(c)))


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


# Coefficients of Acklam's rational approximation of the normal quantile.
_CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def normal_quantile(p) -> Column:
    """Standard normal quantile of a probability column (relative error about 1e-9)."""
    p = col(p)

    def ratio(parts, x):
        top, bottom = (reduce(lambda acc, c: acc * x + c, cs[1:], F.lit(cs[0])) for cs in parts)
        return top / bottom

    tail = ratio(_TAIL, F.sqrt(-2 * F.ln(F.least(p, 1 - p))))
    q = p - 0.5
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(ratio(_CENTRE, q * q) * q)
