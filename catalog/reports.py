"""The whole season and predictor reports: every frame of a report is computed, and its number of rows compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.models import daily, readings
from catalog.registry import query
from tarnis.plans import predictors, season
from tarnis.smooth import s, te


def _sizes(frames):
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n") for name, df in frames.items()])


_DAYS = "SELECT count(DISTINCT l_shipdate::DATE) AS days, max(year(l_shipdate)) - min(year(l_shipdate)) + 1 AS years FROM lineitem"


@query(
    f"""WITH d AS ({_DAYS}) SELECT unnest(['orders', 'summary', 'statistics', 'autocorrelation', 'k_check', 'diagnostics', 'qq', 'year_change',
    'season_change', 'curves', 'surface', 'observed_vs_predicted']) AS report,
    unnest([2, 3, 1, 37, 3, days, days, 200, 200, 365 * years, 200 * 200, 2 * days])::BIGINT AS n FROM d"""
)
def season_report(spark, d):
    """Orders of autoregressive errors, diagnostics, changes, curves and surface of the year and season model."""
    frames = season.season_report(daily(spark, d), "quantity", ["date"], k_year=6, bounded=True)
    # how many bins and periods there are depends on the fit
    return _sizes({k: v for k, v in frames.items() if k not in ("residual_histogram", "year_periods")})


@query(
    """WITH r AS (SELECT count(*) AS n FROM lineitem) SELECT unnest(['temporal_ranges', 'summary', 'statistics', 'k_check', 'partial_effects', 'diagnostics',
    'qq', 'autocorrelation', 'dropped']) AS report, unnest([1, 3, 1, 3, 3 * n, n, n, 37, 2])::BIGINT AS n FROM r"""
)
def predictor_report(spark, d):
    """Ranges, tests, effects, diagnostics and a dropped term of the predictor model."""
    keys = ["date", "l_orderkey", "l_linenumber"]
    lines = readings(spark, d, "l_orderkey", "l_linenumber")
    terms = [s("flow", k=10), s("sqrt(tax)", k=6), te("year", "DOY", bs=("cr", "cc"), k=(5, 8), knots=season.DOY_KNOTS)]
    frames = predictors.predictor_report(lines, keys, "load", terms, ["s(flow)"], power=1.5)
    return _sizes({k: v for k, v in frames.items() if k != "residual_histogram"})
