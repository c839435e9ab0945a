"""Model comparison and diagnostics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import normal_quantile
from tarnis.functions.stats import chi2_tail, normal_cdf
from tarnis.operators.frame import one_row
from tarnis.operators.order import over_neighbours, with_row_index
from tarnis.operators.quantiles import group_quantiles
from tarnis.operators.summary import histogram
from tarnis.session import settle
from tarnis.smooth.fit import (
    Pass,
    choose_smoothing,
    fit_frame,
    penalties_of,
    penalty_range,
    total_penalty,
)
from tarnis.smooth.model import GamModel


def compare(models: Mapping[str, GamModel], criterion: str = "AIC") -> DataFrame:
    """(model, df, value), for models of the same response and the same number of rows."""
    first = next(iter(models.values()))
    for name, m in models.items():
        if m.frame.response != first.frame.response:
            raise ValueError(f"{name} models {m.frame.response}, not {first.frame.response}")
        if m.n != first.n:
            raise ValueError(f"{name} was fitted to {m.n} rows, the first model to {first.n}")
    value = {"AIC": lambda m: m.aic, "BIC": lambda m: m.bic}[criterion]
    rows = [(name, float(m.parameters), float(value(m))) for name, m in models.items()]
    return first._local(rows, f"model string, df double, {criterion} double")


def lrt(m0: GamModel, m1: GamModel) -> DataFrame:
    """Likelihood ratio of two nested models: (df, statistic, p). Models with AR errors are compared
    by the likelihood of their working models, others by scaled deviance."""
    if m0.frame.response != m1.frame.response or m0.n != m1.n:
        raise ValueError("the models differ in response or rows")
    df = m1.parameters - m0.parameters
    if m0.ar is not None or m1.ar is not None:
        if m0.frame.lags != m1.frame.lags:
            df = len(m1.phi) - len(m0.phi)
        stat = 2 * (m1.working_loglik - m0.working_loglik)
    else:
        stat = (m0.deviance - m1.deviance) / m1.scale
    p = chi2_tail(max(stat, 0.0), df) if df > 0 else float("nan")
    row = (float(df), float(stat), None if math.isnan(p) else float(p))
    return m0._local([row], "df double, statistic double, p double")


def drop_terms(model: GamModel, labels: Sequence[str]) -> dict[str, GamModel]:
    """Refit without each named term, on the same rows and bases. An unknown term raises.

    A Gaussian model needs no further pass over the rows: leaving out a term leaves out rows and
    columns of its cross-product matrix.
    """
    designs = {label: model.design.without([label]) for label in labels}
    out = {}
    if model.family.name == "gaussian" and not model.frame.lags and not model.level:
        for label, design in designs.items():
            out[label] = _submodel(model, design)
        return out
    model.frame.cells.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for label, design in designs.items():
            kept = [t for t in model.terms if t.label != label]
            out[label] = fit_frame(
                model.frame, kept, model.family, model.method, model.select, model.ar, None, design=design
            )
    finally:
        model.frame.cells.unpersist()
    return out


def _submodel(model: GamModel, design) -> GamModel:
    kept = [0]
    for sm in design.smooths:
        old = model.design.term(sm.label)
        kept += range(old.start, old.start + old.size)
    full = model.last
    gram, cross = full.gram[np.ix_(kept, kept)], full.cross[kept]
    r = Pass(gram, cross, full.square, 0.0, 0.0, full.sums, full.lag_products, full.lag_counts, 0.0, 0.0)
    penalties, span = penalties_of(design, gram), penalty_range(design)
    sol = choose_smoothing(r, model.n, penalties, np.ones(len(penalties)), span, model.method, False)
    rss = r.square - 2 * sol.beta @ cross + sol.beta @ gram @ sol.beta
    r.deviance = r.pearson = r.rss = rss
    scale = rss / (model.n - sol.edf.sum())
    return GamModel(
        frame=model.frame, design=design, family=model.family, method=model.method, beta=sol.beta,
        lam=sol.lam, covariance=scale * sol.inverse, edf_coef=sol.edf, scale=float(scale), last=r,
        penalty=total_penalty(design.size, penalties, sol.lam), penalty_span=span,
        inverse=sol.inverse, phi=np.zeros(0), working_score=sol.score,
        terms=[t for t in model.terms if t.label in {s.label for s in design.smooths}],
        select=model.select,
    )


def diagnostics(model: GamModel, df: DataFrame) -> DataFrame:
    """Residuals against the linear predictor and observed against fitted: one row per complete row."""
    made = model.residuals(df).withColumn("observed", F.expr(model.frame.response).cast("double"))
    return made.where(F.col("fitted").isNotNull() & F.col("observed").isNotNull())


def qq_points(model: GamModel, df: DataFrame, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """(rank, sample, theoretical): ordered deviance residuals against normal quantiles."""
    res = settle(diagnostics(model, df).select(F.col("deviance").alias("sample"), *tie_breakers), "residuals")
    ranked = with_row_index(res, ["sample", *tie_breakers], "rank")
    p = (F.col("rank") + 0.5) / float(res.count())
    theoretical = normal_quantile(p) * float(np.sqrt(model.scale))
    return ranked.select("rank", "sample", theoretical.alias("theoretical"))


def residual_histogram(model: GamModel, df: DataFrame, method: str = "select") -> DataFrame:
    """Deviance residuals in bins of Freedman-Diaconis width, 2 IQR / n^(1/3)."""
    # read several times below
    res = settle(diagnostics(model, df).select("deviance"), "residuals")
    q = group_quantiles(res, "deviance", [0.25, 0.75], names=["q1", "q3"], method=method).first()
    width = 2 * (q["q3"] - q["q1"]) * model.n ** (-1 / 3)
    return histogram(res, ["deviance"], width=width if width > 0 else None)


def k_check(model: GamModel, df: DataFrame | None = None) -> DataFrame:
    """Is each basis large enough? (term, max_df, edf, k_index, p).

    Neighbours along a covariate should have unrelated residuals: the index compares the variance
    of residual differences between neighbours with that of all residuals, and is below 1 if
    structure is left. All rows count. Rows with the same covariate value have no order of their
    own; the expectation over all their orders is used, which needs only their number, mean and
    variance, so rows are summed per covariate combination before anything is sorted. The p value
    takes the spread of the index under a random ordering. For smooths of several variables neighbours are those
    along a space-filling curve.
    """
    variables = model.design.variables
    covs = [f"x{i}" for i in range(len(variables))]
    if df is None:
        rows = model.fitted_rows()
    else:
        rows = model.residuals(df).select("deviance", *[F.expr(v).alias(x) for v, x in zip(variables, covs)])
    rows = rows.where(F.col("deviance").isNotNull())
    e = F.col("deviance")
    if model.frame.compressed:
        sums = rows.groupBy(*covs).agg(F.count(e).alias("n"), F.avg(e).alias("m"), F.var_pop(e).alias("v"))
    else:
        sums = rows.select(*covs, F.lit(1).cast("long").alias("n"), e.alias("m"), F.lit(0.0).alias("v"))
    sums = sums.persist(StorageLevel.MEMORY_AND_DISK)
    n, overall = _spread(sums)
    out = []
    for sm in model.design.smooths:
        if sm.term.kind in ("re", "linear"):
            continue
        edf = float(model.edf_coef[sm.block].sum())
        at = [covs[c] for c in sm.columns]
        if len(at) == 1:
            index = _line_index(sums, at[0], n, overall)
        else:
            index = _curve_index(sums, at, n, overall)
        out.append((sm.label, sm.size, edf, float(index), float(normal_cdf((index - 1) * math.sqrt(n)))))
    sums.unpersist()
    return model._local(out, "term string, max_df int, edf double, k_index double, p double")


def _pooled():
    """Count, mean and variance of a union of groups with count n, mean m and variance v."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    square = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / total
    return [total.alias("n"), mean.alias("m"), F.greatest(square - mean * mean, F.lit(0.0)).alias("v")]


def _spread(sums: DataFrame) -> tuple[int, float]:
    r = sums.agg(*_pooled()).first()
    return r["n"], r["n"] * r["v"] / (r["n"] - 1)


def _steps_index(values: DataFrame, order: Sequence[str], n: int, overall: float) -> float:
    """Half the mean squared difference between neighbours in an order, over the variance. `values` has a row (n, m, v) for
    each group of equal covariates: differences count inside the groups and from group to group."""
    previous = {f"{c}0": (lambda w, c=c: F.lag(c).over(w)) for c in ("m", "v")}
    stepped = over_neighbours(values, previous, list(order), before=1)
    jump = F.col("v") + F.col("v0") + F.pow(F.col("m") - F.col("m0"), F.lit(2))
    r = stepped.agg(F.sum(2 * F.col("n") * F.col("v")).alias("inside"), F.sum(jump).alias("between")).first()
    return (r["inside"] + (r["between"] or 0.0)) / (2 * (n - 1)) / overall


def _line_index(sums: DataFrame, x: str, n: int, overall: float) -> float:
    return _steps_index(sums.groupBy(x).agg(*_pooled()), [x], n, overall)


#: Cells of an axis on the curve, as a power of two.
CURVE_BITS = 15


def curve_place(places: Sequence[Column], bits: int = CURVE_BITS) -> Column:
    """Place along a space-filling curve of a point given by whole numbers below 2^bits. In two dimensions it is Hilbert's, whose
    steps never leave the next cell; in more the digits of the numbers are interleaved."""
    if len(places) != 2:
        bits = min(bits, 62 // len(places))
        taken = [F.shiftright(p.cast("long"), CURVE_BITS - bits) for p in places]
        out = F.lit(0).cast("long")
        for b in range(bits):
            for i, p in enumerate(taken):
                out = out.bitwiseOR(F.shiftleft(F.shiftright(p, b).bitwiseAND(F.lit(1)), b * len(taken) + i))
        return out

    def turn(at, side):
        right, up = (F.when(at[c].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)) for c in ("x", "y"))
        flip = lambda c: F.when((up == 0) & (right == 1), F.lit((1 << bits) - 1).cast("long") - at[c]).otherwise(at[c])
        x, y = flip("x"), flip("y")
        return F.struct(
            F.when(up == 0, y).otherwise(x).alias("x"), F.when(up == 0, x).otherwise(y).alias("y"),
            (at["d"] + side * side * (3 * right).bitwiseXOR(up)).alias("d"),
        )

    start = F.struct(places[0].cast("long").alias("x"), places[1].cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    sides = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(bits))])
    return F.aggregate(sides, start, turn)["d"]


def _curve_index(sums: DataFrame, at: Sequence[str], n: int, overall: float) -> float:
    """Neighbours of several covariates: those next to each other along a space-filling curve over their ranges."""
    values = sums.groupBy(*at).agg(*_pooled())
    ends = one_row(values.agg(*[F.min(x).alias(f"lo_{x}") for x in at], *[F.max(x).alias(f"hi_{x}") for x in at]))
    most = (1 << CURVE_BITS) - 1
    places = [
        F.coalesce(F.least(F.floor(F.try_divide(F.col(x) - ends[f"lo_{x}"], ends[f"hi_{x}"] - ends[f"lo_{x}"]) * (most + 1)), F.lit(most)), F.lit(0)).alias(f"_{x}")
        for x in at
    ]
    values = values.select("n", "m", "v", *at, *places)
    values = values.withColumn("_at", curve_place([F.col(f"_{x}") for x in at]))
    return _steps_index(values, ["_at", *at], n, overall)
