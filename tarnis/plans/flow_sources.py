"""Comparison of two flow sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tarnis.functions.columns import col
from tarnis.operators.filters import complete_cases
from tarnis.operators.regression import ols
from tarnis.operators.summary import corr_matrix, density, summary_quartiles, threshold_group
from tarnis.session import settle

# Fixed value: flow in m3/s that separates low from high watershed flow.
QWS_THRESHOLD = 0.2069


REPORTS = ("coefficients", "fit", "residuals", "correlation", "quartiles", "density")


def compare_sources(
    df: DataFrame,
    y: str = "QLD",
    x: str = "QWS",
    threshold: float = QWS_THRESHOLD,
    reports: Sequence[str] = REPORTS,
) -> dict[str, DataFrame]:
    """Regression of y on x, their correlation, quartiles of x, and the density of y on either
    side of a threshold of x."""
    # two columns, read several times below
    rows = settle(complete_cases(complete_cases(df, [x]), [y]).select(col(x), col(y)), "flows")
    out = {}
    if {"coefficients", "fit", "residuals"} & set(reports):
        fit = ols(rows, y, [x])
        made = {"coefficients": fit.coefficients, "fit": fit.summary, "residuals": fit.residual_summary}
        out |= {name: made[name]() for name in made if name in reports}
    if "correlation" in reports:
        out["correlation"] = corr_matrix(rows, [x, y])
    if "quartiles" in reports:
        out["quartiles"] = summary_quartiles(rows, x)
    if "density" in reports:
        out["density"] = density(threshold_group(rows, x, threshold), y, ["group"])
    return out
