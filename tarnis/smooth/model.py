"""A fitted model: summaries, predictions, derivatives and surfaces.

Coefficients and their covariance are small; they travel with the function that evaluates the basis,
and every prediction is a projection of the frame it is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnis.functions.stats import f_tail, t_quantile
from tarnis.operators.frame import one_row
from tarnis.operators.joins import grid, mask_far
from tarnis.operators.quantiles import group_quantiles
from tarnis.operators.reshape import to_long
from tarnis.operators.series import significant_change
from tarnis.session import settle
from tarnis.smooth.sums import sum_over_rows


def _struct(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@dataclass
class GamModel:
    frame: object = field(repr=False)
    design: object = field(repr=False)
    family: object
    method: str
    beta: np.ndarray = field(repr=False)
    lam: np.ndarray
    covariance: np.ndarray = field(repr=False)
    edf_coef: np.ndarray = field(repr=False)
    scale: float
    last: object = field(repr=False)  # sums at the final coefficients
    penalty: np.ndarray = field(repr=False)
    penalty_span: np.ndarray = field(repr=False)
    inverse: np.ndarray = field(repr=False)
    phi: np.ndarray
    working_score: float
    terms: list = field(default_factory=list, repr=False)
    select: bool = False
    ar: object = None
    level: object = field(default=None, repr=False)  # the levels of a random effect
    converged: bool = True
    gradient: float = 0.0  # of the score in the log smoothing parameters, at the end

    # --- numbers ---

    @property
    def n(self) -> int:
        return self.frame.n

    @property
    def total(self):
        return self.frame.total

    @property
    def deviance(self) -> float:
        return float(self.last.deviance)

    @property
    def sums(self):
        return self.last.sums

    @property
    def edf(self) -> float:
        return float(self.edf_coef.sum()) + (self.level.edf if self.level else 0.0)

    @property
    def residual_df(self) -> float:
        return self.n - self.edf

    @cached_property
    def null_deviance(self) -> float:
        f, fr = self.family, self.frame
        if f.by_row:
            mean = fr.mean
            partial = lambda pdf: np.array(
                [f.deviance(1.0, pdf["y"].to_numpy(), 0.0, np.full(len(pdf), mean)).sum()]
            )
            return float(sum_over_rows(fr.rows.select("y"), partial, fr.parts)[0])
        one = np.array([1.0])
        cell = f.deviance(fr.n * one, fr.mean * one, fr.m2 * one, fr.mean * one)
        return float(cell[0]) + f.deviance_constant(self.total)

    @property
    def deviance_explained(self) -> float:
        return 1 - self.deviance / self.null_deviance

    @property
    def r2_adjusted(self) -> float:
        return 1 - (self.last.rss / self.residual_df) / (self.frame.m2 / (self.n - 1))

    def base_measure(self, family) -> float:
        """Sum of the part of a Tweedie log-density that has no mean in it: one pass over y."""
        scale = self.scale

        def partial(pdf: pd.DataFrame) -> np.ndarray:
            y, count = np.unique(pdf["y"].to_numpy(), return_counts=True)
            return np.array([count @ family.log_base(y, scale)])

        return float(sum_over_rows(self.frame.rows.select("y"), partial, self.frame.parts)[0])

    @cached_property
    def loglik(self) -> float:
        """Log-likelihood; with AR errors, of whatever order, that of the whitened working model, so that orders
        (0 among them) can be compared."""
        if self.ar is not None:
            return self.working_loglik
        return float(self.family.loglik(self))

    @property
    def working_loglik(self) -> float:
        r = self.last
        rss = r.square - 2 * self.beta @ r.cross + self.beta @ r.gram @ self.beta
        return float(-0.5 * (self.n * (np.log(2 * np.pi * rss / self.n) + 1) + r.log_det))

    @property
    def parameters(self) -> float:
        return self.edf + self.family.parameters + len(self.phi)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters

    @property
    def bic(self) -> float:
        return -2 * self.loglik + np.log(self.n) * self.parameters

    @cached_property
    def criterion(self) -> float:
        """Laplace REML or ML score (negative log, at the reported scale)."""
        if len(self.phi):
            return self.working_score
        span, h = self.penalty_span, self.last.gram + self.penalty
        unpenalised = self.design.size - span.shape[1]
        log_s = np.linalg.slogdet(span.T @ self.penalty @ span)[1] if span.shape[1] else 0.0
        fit = (self.deviance + self.beta @ self.penalty @ self.beta) / (2 * self.scale)
        if self.level:
            fit += self.level.penalty / (2 * self.scale) + self.level.log_det / 2
        if self.method == "ML":
            log_h = np.linalg.slogdet(span.T @ h @ span)[1] if span.shape[1] else 0.0
            return float(fit - self.family.saturated(self) + (log_h - log_s) / 2)
        log_h = np.linalg.slogdet(h)[1]
        return float(
            fit - self.family.saturated(self) + (log_h - log_s - unpenalised * np.log(2 * np.pi * self.scale)) / 2
        )

    def summary(self) -> DataFrame:
        """One row per smooth: (term, edf, max_df, f, p). A random effect kept as a table of levels is tested by the mean
        square of its effects against the scale."""
        rows = []
        gram = self.level.gram if self.level else self.last.gram
        for sm in self.design.smooths:
            b, v = self.beta[sm.block], self.covariance[sm.block, sm.block]
            edf = float(self.edf_coef[sm.block].sum())
            rank = max(1, min(sm.size, round(edf)))
            # on the scale of the fitted curve: X'WX = R'R, test R b with covariance R V R'
            size, axes = np.linalg.eigh(gram[sm.block, sm.block])
            root = np.sqrt(np.maximum(size, 0))[:, None] * axes.T
            values, vectors = np.linalg.eigh(root @ v @ root.T)
            lead = np.argsort(-values)[:rank]
            stat = float(np.sum((vectors[:, lead].T @ (root @ b)) ** 2 / values[lead])) / rank
            rows.append((sm.label, edf, sm.size, stat, f_tail(stat, rank, self.residual_df)))
        if self.level:
            weighted = self.level.effects.agg(F.sum(F.col("d") * F.col("u") * F.col("u"))).first()[0]
            edf = self.level.edf
            stat = float(weighted) / (max(edf, 1e-12) * self.scale)
            rows.append((self.level.term.label, edf, self.level.count, stat, f_tail(stat, max(edf, 1e-6), self.residual_df)))
            order = [t.label for t in self.terms]
            rows.sort(key=lambda r: order.index(r[0]) if r[0] in order else len(order))
        return self._local(rows, "term string, edf double, max_df int, f double, p double")

    def statistics(self) -> DataFrame:
        """One row: family, n, edf, scale, deviance explained, adjusted R2, criterion, AIC, BIC, whether the fit converged, and the
        gradient of the criterion in the log smoothing parameters."""
        row = (
            self.family.name, self.n, self.edf, self.scale, self.deviance, self.deviance_explained,
            float(self.r2_adjusted), self.method, self.criterion, self.loglik, self.aic, self.bic,
            float(self.family.variance_power), [float(a) for a in self.phi], self.converged, self.gradient,
        )
        return self._local(
            [tuple(float(v) if isinstance(v, np.floating) else v for v in row)],
            "family string, n long, edf double, scale double, deviance double,"
            " deviance_explained double, r2_adjusted double, method string, criterion double,"
            " loglik double, aic double, bic double, variance_power double, ar array<double>,"
            " converged boolean, gradient double",
        )

    def coefficients(self) -> DataFrame:
        names = ["(Intercept)"]
        for sm in self.design.smooths:
            names += [f"{sm.label}.{i}" for i in range(1, sm.size + 1)]
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        rows = [(n, float(b), float(s)) for n, b, s in zip(names, self.beta, se)]
        return self._local(rows, "coefficient string, estimate double, se double")

    def _local(self, rows, schema) -> DataFrame:
        return self.frame.cells.sparkSession.createDataFrame(rows, schema)

    # --- evaluation on a frame ---

    def _covariates(self, names: Mapping[str, str] | None = None) -> Column:
        """The model's variables as one struct column (`names` maps a variable to a ready column)."""
        kinds = {t.variables[0] for t in self.terms if t.kind == "re"}
        cols = []
        for i, v in enumerate(self.design.variables):
            c = F.col(f"`{names[v]}`") if names and v in names else F.expr(v)
            cols.append(c.cast("string" if v in kinds else "double").alias(f"x{i}"))
        return cols

    def _with_values(self, df: DataFrame, make, fields: Sequence[str], names=None, level: bool = False) -> DataFrame:
        """Add `make(values)` as the struct column _p, NULL where a covariate is missing.

        Bases are evaluated once per value of each covariate in a batch and looked up for its rows, so nothing is joined and the other
        columns stay in the JVM. With `level`, `make` also gets what is known of the row's level: effect, shares and own variance
        (zeros for a level that the fit has not seen).
        """
        inputs = self._covariates(names)
        extra = 3 if level and self.level else 0
        if extra:
            known = self.level.effects.select(F.col("level").alias("_l"), F.struct("u", "g", "v").alias("_level"))
            df = df.withColumn("_key", inputs[self.level.term.column]).join(known, F.col("_key") == F.col("_l"), "left").drop("_l", "_key")
            none = F.array_repeat(F.lit(0.0), self.design.size)
            parts = (F.coalesce("_level.u", F.lit(0.0)), F.coalesce("_level.g", none), F.coalesce("_level.v", F.lit(0.0)))
            inputs = inputs + [c.alias(f"_{n}") for n, c in zip("ugv", parts)]

        @F.pandas_udf(_struct(fields))
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ok = pdf.notna().all(axis=1).to_numpy()
            out = np.full((len(pdf), len(fields)), np.nan)
            if ok.any():
                known = pdf[ok]
                values = [known[c].to_numpy() for c in known.columns]
                if extra:
                    values[-2] = np.vstack(values[-2])
                out[ok] = np.column_stack(make(values))
            return pd.DataFrame(out, columns=list(fields))

        out = df.withColumn("_p", run(F.struct(*inputs)))
        return out.drop("_level") if extra else out

    def _observed(self) -> Column:
        return F.expr(self.frame.response).cast("double")

    def _mean(self, eta: Column) -> Column:
        return F.exp(eta) if self.family.log_link else eta

    def _working(self, y: Column, mu: Column) -> Column:
        return (y - mu) / mu if self.family.log_link else y - mu

    def _link(self):
        design, beta, cov, level = self.design, self.beta, self.covariance, self.level is not None

        def make(values):
            x = design.matrix(values)
            eta, own = x @ beta, 0.0
            if level:
                eta, own, x = eta + values[-3], values[-1], x - values[-2]
            return eta, np.sqrt(np.maximum(np.einsum("ij,ij->i", x @ cov, x) + own, 0))

        return make

    def predict(self, df: DataFrame, se: bool = True, scale: str = "link", crit: float = 1.96, names=None) -> DataFrame:
        """Add fit and, with `se`, the standard error and interval.

        On the response scale the fit and the interval bounds are transformed; `se` stays on the link
        scale and `se_response` is its first-order equivalent.
        """
        out = self._with_values(df, self._link(), ["fit", "se"], names, level=True)
        eta, err = F.col("_p.fit"), F.col("_p.se")
        back = F.exp if self.family.log_link and scale == "response" else (lambda c: c)
        made = {"fit": back(eta)}
        if se:
            made |= {"se": err, "lower": back(eta - crit * err), "upper": back(eta + crit * err)}
            if scale == "response":
                made["se_response"] = (F.exp(eta) if self.family.log_link else F.lit(1.0)) * err
        return out.withColumns(made).drop("_p")

    def predict_terms(self, df: DataFrame, term: str, names=None) -> DataFrame:
        """Add one term's contribution, its standard error and the model constant."""
        sm, beta, cov = self.design.term(term), self.beta, self.covariance
        level = self.level is not None and sm is self.level.term
        out = self._with_values(df, self._level_effect if level else self._term_effect(sm), ["effect", "se"], names, level)
        return out.withColumns(
            {"effect": F.col("_p.effect"), "effect_se": F.col("_p.se"), "constant": F.lit(float(beta[0]))}
        ).drop("_p")

    def _term_effect(self, sm):
        b, v = self.beta[sm.block], self.covariance[sm.block, sm.block]

        def make(values):
            x = sm.design(values)
            return x @ b, np.sqrt(np.maximum(np.einsum("ij,ij->i", x @ v, x), 0))

        return make

    @property
    def _level_effect(self):
        cov = self.covariance

        def make(values):
            u, g, own = values[-3:]
            return u, np.sqrt(np.maximum(np.einsum("ij,ij->i", g @ cov, g) + own, 0))

        return make

    def residuals(self, df: DataFrame) -> DataFrame:
        """Add linear_predictor, fitted and the working, Pearson and deviance residuals."""
        out = self._with_values(df, self._link(), ["fit", "se"], level=True)
        return self._add_residuals(out, self._observed())

    def fitted_rows(self) -> DataFrame:
        """The rows of the fit (y, x0, x1, ... as evaluated then) with their residuals."""
        names = {v: f"x{i}" for i, v in enumerate(self.design.variables)}
        rows = self.frame.rows.select("y", *names.values())
        out = self._with_values(rows, self._link(), ["fit", "se"], names, level=True)
        return self._add_residuals(out, F.col("y"))

    def _add_residuals(self, df: DataFrame, y: Column) -> DataFrame:
        eta = F.col("_p.fit")
        mu = self._mean(eta)
        unit = F.greatest(self.family.unit_deviance(y, mu), F.lit(0.0))
        return df.withColumns(
            {
                "linear_predictor": eta,
                "fitted": mu,
                "working": self._working(y, mu),
                "pearson": (y - mu) / F.sqrt(self.family.variance_of(mu)),
                "deviance": F.signum(y - mu) * F.sqrt(unit),
            }
        ).drop("_p")

    # --- derived reports ---

    def _support(self) -> DataFrame:
        """Where the data lie: covariate combinations with their counts n, under the names of the
        variables. One row per fitted row where combinations do not repeat."""
        names = {f"x{i}": v for i, v in enumerate(self.design.variables)}
        if self.frame.compressed:
            points = self.frame.cells.select(*names, "n")
        else:
            points = self.frame.rows.select(*names, F.lit(1.0).alias("n"))
        return points.withColumnsRenamed(names)

    def _medians(self, variables: Sequence[str], out: DataFrame) -> DataFrame:
        """Adds the covariates at their medians; a category at its most frequent level (of equals, the first)."""
        points = self._support()
        kinds = dict(points.dtypes)
        for v in variables:
            x = F.col(f"`{v}`")
            if kinds[v] == "string":
                levels = points.groupBy(x.alias("m")).agg(F.sum("n").alias("n"))
                out = out.withColumn(v, one_row(levels.agg(F.min_by("m", F.struct(-F.col("n"), F.col("m"))).alias("m")))["m"])
                continue
            middle = group_quantiles(points, x, [0.5], names=["m"], weight="n")
            out = out.withColumn(v, one_row(middle)["m"])
        return out

    def line(self, variable: str, n: int = 200) -> DataFrame:
        """Grid along one variable between its extremes, the others held at their medians."""
        points = grid(self._support(), {variable: n})
        others = [v for v in self.design.variables if v != variable]
        return self._medians(others, points)

    def smooth_derivative(self, term: str, variable: str | None = None, n: int = 200, crit: float = 1.96) -> DataFrame:
        """Central-difference slope of a smooth on a grid, with standard error and interval."""
        sm = self.design.term(term)
        variable = variable or sm.term.variables[0]
        at = self.design.variables.index(variable)
        b, v = self.beta[sm.block], self.covariance[sm.block, sm.block]

        def make(values):
            x = np.asarray(values[at], dtype=float)
            eps = 1e-6 * np.maximum(np.abs(x), 1.0)
            up, down = list(values), list(values)
            up[at], down[at] = x + eps, x - eps
            d = (sm.design(up) - sm.design(down)) / (2 * eps)[:, None]
            return d @ b, np.sqrt(np.maximum(np.einsum("ij,ij->i", d @ v, d), 0))

        points = self.line(variable, n)
        names = {c: c for c in self.design.variables}
        out = self._with_values(points, make, ["derivative", "se"], names)
        d, e = F.col("_p.derivative"), F.col("_p.se")
        return out.withColumns(
            {"derivative": d, "derivative_se": e, "lower_ci": d - crit * e, "upper_ci": d + crit * e}
        ).drop("_p")

    def change(self, term: str, variable: str | None = None, n: int = 200) -> DataFrame:
        """Fitted curve along one variable with its interval (response scale) and, per point, whether
        the slope of the smooth differs from zero: sig 1 = change, 2 = none."""
        d = self.smooth_derivative(term, variable, n)
        flagged = significant_change(d, "lower_ci", "upper_ci")
        return self.predict(flagged, scale="response", names={c: c for c in self.design.variables})

    def seasonal_curves(self, year: str = "year", doy: str = "DOY", years: tuple[int, int] | None = None, days: int = 365) -> DataFrame:
        """Seasonal curve of every year with its interval, on the response scale."""
        rows = self._support()
        if years:
            bounds = rows.agg(F.min(F.lit(years[0])).alias("lo"), F.max(F.lit(years[1])).alias("hi"))
        else:
            bounds = rows.agg(
                F.min(F.col(f"`{year}`")).cast("int").alias("lo"), F.max(F.col(f"`{year}`")).cast("int").alias("hi")
            )
        points = bounds.select(F.explode(F.sequence("lo", "hi")).alias(year))
        points = points.select(year, F.explode(F.sequence(F.lit(1), F.lit(days))).alias(doy))
        others = [v for v in self.design.variables if v not in (year, doy)]
        crit = t_quantile(0.975, self.residual_df)
        names = {c: c for c in self.design.variables}
        return self.predict(self._medians(others, points), scale="response", crit=crit, names=names)

    def response_surface(self, term: str, n: int = 200, dist: float = 0.1) -> DataFrame:
        """One two-way smooth plus the constant on an n x n grid, response scale; NULL where no
        observation is near."""
        sm = self.design.term(term)
        a, b = sm.term.variables
        points = grid(self._support(), {a: n, b: n})
        others = [v for v in self.design.variables if v not in (a, b)]
        # other variables do not enter this term
        points = points.withColumns({v: F.lit(0.0) for v in others})
        names = {c: c for c in self.design.variables}
        shown = self.predict_terms(points, term, names=names)
        flagged = mask_far(shown, self._support().select(F.col(f"`{a}`"), F.col(f"`{b}`")), (a, b), dist, (n, n))
        total = F.col("effect") + F.col("constant")
        value = F.exp(total) if self.family.log_link else total
        return flagged.withColumn("value", F.when(~F.col("too_far"), value)).drop(*others)

    def observed_vs_predicted(self, df: DataFrame, ids: Sequence[str]) -> DataFrame:
        """Observed and predicted values side by side in long form: (ids..., fit, value)."""
        made = self.predict(df, scale="response", se=False).withColumnRenamed("fit", "Predicted")
        made = made.withColumn("Observed", F.expr(self.frame.response).cast("double"))
        return to_long(made, ids, ["Observed", "Predicted"], "fit", "value")

    def partial_effects(self, df: DataFrame, ids: Sequence[str]) -> DataFrame:
        """Every term's effect per row with its standard error and partial residual, long form."""
        smooths = [*self.design.smooths, *([self.design.level] if self.level else [])]
        fields = ["eta", *[f"{kind}{i}" for i in range(len(smooths)) for kind in ("effect", "se")]]
        link = self._link()
        effects = [self._level_effect if sm is self.design.level else self._term_effect(sm) for sm in smooths]

        def make(values):
            out = [link(values)[0]]
            for effect in effects:
                out += effect(values)
            return out

        wide = self._with_values(df, make, fields, level=True)
        working = self._working(self._observed(), self._mean(F.col("_p.eta")))
        per_term = F.array(
            *[
                F.struct(
                    F.lit(sm.label).alias("term"),
                    F.col(f"_p.effect{i}").alias("effect"),
                    F.col(f"_p.se{i}").alias("se"),
                    (F.col(f"_p.effect{i}") + working).alias("partial_residual"),
                )
                for i, sm in enumerate(smooths)
            ]
        )
        return wide.select(*ids, F.explode(per_term).alias("e")).select(*ids, "e.*")
