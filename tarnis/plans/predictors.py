"""Predictor model: nutrients, flow, climate and season."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.operators.series import correlogram
from tarnis.operators.summary import temporal_ranges
from tarnis.plans.season import DOY_KNOTS
from tarnis.smooth import gam, re, s, te, ti
from tarnis.smooth.check import (
    compare,
    diagnostics,
    drop_terms,
    k_check,
    qq_points,
    residual_histogram,
)
from tarnis.smooth.model import GamModel
from tarnis.smooth.terms import Term


def predictor_terms() -> list[Term]:
    """Terms of the final model."""
    return [
        s("SRP", k=10),
        s("DIN", k=10),
        s("QLD", k=7),
        te("PDO_3MON_AVG", "SOI_3MON_AVG"),
        te("year", "DOY", bs=("cr", "cc"), k=(10, 12), knots=DOY_KNOTS),
    ]


def candidate_terms() -> dict[str, list[Term]]:
    """Terms of the models compared on the way: time left out, as a tensor, as a random effect;
    climate as separate smooths and as an interaction."""
    nutrients = [s("sqrt(SRP)"), s("sqrt(DIN)"), s("QLD")]
    climate = te("PDO_3MON_AVG", "SOI_3MON_AVG")
    season = te("year", "DOY", bs=("cr", "cc"), k=(10, 12), knots=DOY_KNOTS)
    return {
        "no_time": [*nutrients, climate],
        "year_tensor": [*nutrients, climate, season],
        "year_effect": [*nutrients, s("W_temp"), climate, re("year")],
        "climate_separate": [*nutrients, s("PDO_3MON_AVG"), s("SOI_3MON_AVG"), season],
        "climate_interaction": [
            *nutrients,
            ti("PDO_3MON_AVG"),
            ti("SOI_3MON_AVG"),
            ti("PDO_3MON_AVG", "SOI_3MON_AVG"),
            season,
        ],
    }


def fit_predictors(df: DataFrame, response: str = "chla", terms: Sequence[Term] | None = None, **options) -> GamModel:
    settings = {"family": "tweedie", "method": "REML", "select": True} | options
    return gam(df, response, terms or predictor_terms(), **settings)


def compare_candidates(df: DataFrame, response: str, candidates: Mapping[str, Sequence[Term]], criterion: str = "AIC", **options) -> DataFrame:
    """Fit each candidate to the rows where all their covariates are known, and compare."""
    variables = sorted({v for terms in candidates.values() for t in terms for v in t.variables})
    for v in [response, *variables]:
        df = df.where(F.expr(v).isNotNull() & ~F.coalesce(F.isnan(F.expr(v).try_cast("double")), F.lit(False)))
    models = {name: fit_predictors(df, response, terms, **options) for name, terms in candidates.items()}
    return compare(models, criterion)


def predictor_report(df: DataFrame, order: Sequence[str], response: str = "chla", terms: Sequence[Term] | None = None, drop: Sequence[str] = (), **options) -> dict[str, DataFrame]:
    """Everything the predictor analysis reports, as frames."""
    model = fit_predictors(df, response, terms, **options)
    residuals = model.residuals(df)
    out = {
        "temporal_ranges": temporal_ranges(df, response),
        "summary": model.summary(),
        "statistics": model.statistics(),
        "k_check": k_check(model),
        "partial_effects": model.partial_effects(df, order),
        "diagnostics": diagnostics(model, df),
        "qq": qq_points(model, df, order),
        "residual_histogram": residual_histogram(model, df),
        "autocorrelation": correlogram(residuals, "deviance", order),
    }
    if drop:
        out["dropped"] = compare({"full": model, **drop_terms(model, drop)})
    return out
