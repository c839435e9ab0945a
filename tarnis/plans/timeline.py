"""Annual timelines with climate phases, and decadal means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import col
from tarnis.operators.joins import label_phases
from tarnis.operators.summary import DECADES, annual_extreme, decadal_mean


def annual_timeline(
    df: DataFrame,
    variables: Sequence[str],
    date: str,
    phases: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Annual mean, max and min of several variables, labelled with the phase of the year:
    (by..., variable, year, mean, max, min, phase).

    One scan and one aggregate serve all variables; years are laid out per variable afterwards.
    """
    stats = []
    for i, v in enumerate(variables):
        x = col(v).cast("double")
        stats += [f(x).alias(f"{n}{i}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    yearly = df.groupBy(*by, F.year(col(date)).alias("year")).agg(*stats)
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"),
                *[F.col(f"{n}{i}").alias(n) for n in ("mean", "max", "min")],
            )
            for i, v in enumerate(variables)
        ]
    )
    long = yearly.select(*by, "year", F.explode(rows).alias("r")).select(*by, "r.variable", "year", "r.mean", "r.max", "r.min")
    long = long.where(F.col("mean").isNotNull())
    return long if phases is None else label_phases(long, phases, "year")


def decadal_temperature(df: DataFrame, value: str, date: str, how: str = "max", breaks=DECADES, by: Sequence[str] = (), method: str = "select") -> DataFrame:
    """Annual extreme (or mean) and its mean per decade: (by..., decade, mean, years)."""
    annual = annual_extreme(df, value, date, how, by, method)
    open_start = breaks is not DECADES
    return decadal_mean(annual, how, "median_date", breaks, by, open_start)
