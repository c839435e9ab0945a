"""Year and season model: fit with and without autoregressive errors, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import day_month_year, decimal_year_to_date
from tarnis.operators.series import ar_residuals, change_periods, correlogram
from tarnis.smooth import gam, s, ti
from tarnis.smooth.check import compare, diagnostics, k_check, qq_points, residual_histogram
from tarnis.smooth.fit import AR
from tarnis.smooth.model import GamModel

# Fixed value: end knots of the cycle of the day of the year.
DOY_KNOTS = {"DOY": (0, 366.5)}


def season_terms(k_year: int = 20, k_doy: int = 12):
    return [
        s("DOY", bs="cc", k=k_doy, knots=DOY_KNOTS),
        s("year", bs="cr", k=k_year),
        ti("DOY", "year", bs=("cc", "cr"), knots=DOY_KNOTS),
    ]


def fit_season(
    df: DataFrame,
    response: str,
    order: Sequence[str],
    max_ar: int = 3,
    k_year: int = 20,
    family: str = "gamma",
    bounded: bool = False,
) -> dict[int, GamModel]:
    """The model with AR(p) errors within years, for p = 0..max_ar."""
    terms = season_terms(k_year)
    return {
        p: gam(df, response, terms, family=family, ar=AR(p, "year", order, bounded))
        for p in range(max_ar + 1)
    }


def choose_order(models: dict[int, GamModel]) -> tuple[int, DataFrame]:
    table = compare({f"AR({p})": m for p, m in models.items()})
    return min(models, key=lambda p: models[p].aic), table


def change_report(model: GamModel, term: str = "s(year)", n: int = 200) -> DataFrame:
    """Periods of significant change along the year smooth: (start, end, start_date, end_date, n)."""
    curve = model.change(term, n=n)
    curve = curve.withColumn("changed", F.col("sig") == 1)
    variable = model.design.term(term).term.variables[0]
    periods = change_periods(curve, variable, "changed", bounded=True)
    return periods.withColumns(
        {
            "start_date": day_month_year(decimal_year_to_date("start")),
            "end_date": day_month_year(decimal_year_to_date("end")),
        }
    )


def season_report(
    df: DataFrame,
    response: str,
    order: Sequence[str],
    max_ar: int = 1,
    k_year: int = 20,
    surface: int = 200,
    bounded: bool = False,
) -> dict[str, DataFrame]:
    """Everything the year and season analysis reports, as frames."""
    models = fit_season(df, response, order, max_ar, k_year, bounded=bounded)
    best, table = choose_order(models)
    model = models[best]
    residuals = model.residuals(df)
    phi = list(model.phi)
    if phi:
        residuals = ar_residuals(residuals, "pearson", order, ["year"], phi, bounded=bounded)
    else:
        residuals = residuals.withColumn("normalized", F.col("pearson"))
    return {
        "orders": table,
        "summary": model.summary(),
        "statistics": model.statistics(),
        "autocorrelation": correlogram(residuals, "normalized", order),
        "k_check": k_check(model),
        "diagnostics": diagnostics(model, df),
        "qq": qq_points(model, df, order),
        "residual_histogram": residual_histogram(model, df),
        "year_change": model.change("s(year)"),
        "year_periods": change_report(model),
        "season_change": model.change("s(DOY)"),
        "curves": model.seasonal_curves(),
        "surface": model.response_surface("ti(DOY,year)", n=surface),
        "observed_vs_predicted": model.observed_vs_predicted(df, order),
    }
