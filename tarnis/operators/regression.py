"""Ordinary least squares from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import col
from tarnis.functions.stats import f_tail, t_two_sided
from tarnis.operators.quantiles import group_quantiles


@dataclass
class LinearFit:
    terms: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    r2: float
    adj_r2: float
    sigma: float
    df: int
    f_stat: float
    data: DataFrame = field(repr=False)
    response: str = ""

    def coefficients(self) -> DataFrame:
        """(term, estimate, se, t, p)."""
        rows = []
        for name, b, s in zip(self.terms, self.coef, self.se):
            t = b / s if s > 0 else float("inf")
            rows.append((name, float(b), float(s), float(t), float(t_two_sided(abs(t), self.df))))
        return self._frame(rows, "term string, estimate double, se double, t double, p double")

    def summary(self) -> DataFrame:
        k = len(self.terms) - 1
        p = f_tail(self.f_stat, k, self.df)
        numbers = [float(v) for v in (self.r2, self.adj_r2, self.sigma)]
        row = (self.n, *numbers, self.df, float(self.f_stat), float(p))
        return self._frame(
            [row], "n long, r2 double, adj_r2 double, sigma double, df int, f double, p double"
        )

    def with_residuals(self, df: DataFrame | None = None) -> DataFrame:
        fitted = F.lit(float(self.coef[0]))
        for name, b in zip(self.terms[1:], self.coef[1:]):
            fitted = fitted + float(b) * col(name)
        df = self.data if df is None else df
        return df.withColumn("fitted", fitted).withColumn("residual", col(self.response) - F.col("fitted"))

    def residual_summary(self, method: str = "select") -> DataFrame:
        """min, q1, median, q3 and max of the residuals."""
        names = ["min", "q1", "median", "q3", "max"]
        return group_quantiles(self.with_residuals(), "residual", [0, 0.25, 0.5, 0.75, 1], (), names, method)

    def _frame(self, rows, schema) -> DataFrame:
        return self.data.sparkSession.createDataFrame(rows, schema)


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> LinearFit:
    """Least squares with intercept on the complete rows. One pass collects the means and the
    (k+1) x (k+1) covariance matrix; the solve happens on those."""
    names = [y, *xs]
    data = df.na.drop(subset=names)
    values = [col(c).cast("double") for c in names]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]
    aggs += [
        F.covar_pop(a, b).alias(f"c{i}_{j}")
        for i, a in enumerate(values)
        for j, b in enumerate(values)
        if j >= i
    ]
    row = data.agg(*aggs).first()
    n, k = row["n"], len(xs)
    if n <= k + 1:
        raise ValueError(f"{n} complete rows are too few for {k} predictors")
    mean = np.array([row[f"m{i}"] for i in range(k + 1)])
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    sxx, sxy = cov[1:, 1:], cov[1:, 0]
    slope = np.linalg.solve(sxx, sxy)
    intercept = mean[0] - slope @ mean[1:]
    rss = max(n * (cov[0, 0] - slope @ sxy), 0.0)
    tss = n * cov[0, 0]
    df_res = n - k - 1
    sigma2 = rss / df_res
    inv = np.linalg.inv(sxx) / n
    var_slope = sigma2 * np.diag(inv)
    var_intercept = sigma2 * (1 / n + mean[1:] @ inv @ mean[1:])
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    f_stat = ((tss - rss) / k) / sigma2 if sigma2 > 0 else float("inf")
    return LinearFit(
        ["(Intercept)", *xs],
        np.concatenate([[intercept], slope]),
        np.sqrt(np.concatenate([[var_intercept], var_slope])),
        n,
        r2,
        1 - (1 - r2) * (n - 1) / df_res,
        float(np.sqrt(sigma2)),
        df_res,
        f_stat,
        data,
        y,
    )
