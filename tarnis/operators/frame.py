"""Projections and column algebra on frames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import (
    DETECTION_LIMITS,
    col,
    half_limit,
    label_if,
    nan_to_null,
    phase_label,
    strict_sum,
    week_of_year,
)
from tarnis.session import settle


def select_columns(df: DataFrame, first: Sequence[str], rest: bool = False, drop: Sequence[str] = ()) -> DataFrame:
    """Pick and reorder columns; `rest=True` appends all the others."""
    names = [*first, *([c for c in df.columns if c not in first] if rest else [])]
    return df.select(*[col(c) for c in names if c not in drop])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old -> new. A missing source column raises."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def strip_prefix(df: DataFrame, pattern: str) -> DataFrame:
    """Remove a leading pattern from every column name that has it (metadata only)."""
    names = [re.sub(rf"^(?:{pattern})", "", c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"stripping {pattern!r} makes column names clash: {names}")
    return df.toDF(*names)


def add_sum(df: DataFrame, out: str, cols: Sequence[str]) -> DataFrame:
    """Sum of parts, NULL if a part is NULL."""
    return df.withColumn(out, strict_sum(cols))


def percent_of(df: DataFrame, parts: Sequence[str], total: str, out: str) -> DataFrame:
    """Share of the parts in a total, in percent; NULL where the total is 0."""
    return df.withColumn(out, F.try_divide(strict_sum(parts), col(total)) * 100)


def numeric_cols(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cast the named columns (default: all text columns) to double; unreadable text is NULL."""
    if cols is None:
        cols = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: col(c).try_cast("double") for c in cols})


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Add year, DOY, nMonth and week."""
    d = col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "DOY": F.dayofyear(d),
            "nMonth": F.month(d),
            "week": week_of_year(d),
        }
    )


def half_detection_limit(df: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    limits = DETECTION_LIMITS if limits is None else limits
    return df.withColumns({c: half_limit(c, limit) for c, limit in limits.items()})


def with_phase(df: DataFrame, pdo: str = "PDO", soi: str = "SOI") -> DataFrame:
    """Two single-index labels and the joint climate phase."""
    return df.withColumns(
        {
            "PDO_desc": label_if(col(pdo) < 0, "Wet", "Dry"),
            "SOI_desc": label_if(col(soi) > 0, "Cool_Wet", "Warm_Dry"),
            "Desc": phase_label(pdo, soi),
        }
    )


def one_row(aggregate: DataFrame) -> Column:
    """A one-row result as a struct-valued scalar subquery: usable in any expression, no join."""
    return aggregate.select(F.struct(*[col(c) for c in aggregate.columns]).alias("s")).scalar()


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each column to mean 0 and sample standard deviation 1, overall or within groups. NaN is missing, and stays so as NULL."""
    pieces = [F.avg(nan_to_null(c)).alias(f"_m{i}") for i, c in enumerate(cols)]
    pieces += [F.stddev_samp(nan_to_null(c)).alias(f"_s{i}") for i, c in enumerate(cols)]
    scale = lambda c, m, s: F.try_divide(nan_to_null(c) - m, s)
    if not by:
        stats = one_row(df.agg(*pieces))
        return df.withColumns(
            {c: scale(c, stats[f"_m{i}"], stats[f"_s{i}"]) for i, c in enumerate(cols)}
        )
    # stored, so that few groups are broadcast to the rows and many are not
    joined = df.join(settle(df.groupBy(*by).agg(*pieces), "zscore"), list(by))
    scaled = {c: scale(c, F.col(f"_m{i}"), F.col(f"_s{i}")) for i, c in enumerate(cols)}
    return joined.withColumns(scaled).select(*[col(c) for c in df.columns])


def with_ci(df: DataFrame, est: str, se: str, crit: float = 1.96, lower="lower", upper="upper") -> DataFrame:
    half = F.lit(crit) * col(se)
    return df.withColumns({lower: col(est) - half, upper: col(est) + half})
