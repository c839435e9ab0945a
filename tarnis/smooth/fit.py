"""Fitting. Executors turn rows into a p x p cross-product matrix and a p vector; the driver picks the
smoothing parameters and solves for the coefficients, and the two alternate until they agree.

References: Wood, Goude and Shaw (2015) for additive models on large data; Wood and Fasiolo (2017)
for the smoothing parameter update.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.functions.stats import lgamma
from tarnis.operators.order import over_neighbours
from tarnis.operators.series import innovations
from tarnis.session import settle
from tarnis.smooth.family import FAMILIES, Family, ScaledT, Tweedie
from tarnis.smooth.levels import Arrow, LevelFit, LevelTerm, halfway, level_sums, with_offset
from tarnis.smooth.model import GamModel
from tarnis.smooth.sums import sum_over_rows
from tarnis.smooth.terms import (
    Design,
    Smooth,
    Term,
    contrast_to,
    marginals,
    null_space_penalty,
    tensor_penalties,
)

log = logging.getLogger(__name__)

MAX_STEPS = 40
TOLERANCE = 1e-7
LAMBDA_RANGE = (1e-8, 1e8)


@dataclass(frozen=True)
class AR:
    """Autoregressive errors of order p within groups, in row order; `phi` gives their coefficients, else they are estimated."""

    p: int
    by: str
    order: Sequence[str]
    bounded: bool = False
    phi: tuple[float, ...] = ()


@dataclass
class Frame:
    """The rows of a fit: covariates x0.., and per cell a count, mean and squared deviations."""

    cells: DataFrame
    rows: DataFrame  # complete rows, uncompressed
    variables: list[str]
    n: int
    mean: float
    m2: float
    total: object
    parts: int
    response: str
    lags: int = 0
    compressed: bool = False  # fewer covariate combinations than rows
    combos: int = 0  # covariate combinations, approximately


def prepare(df: DataFrame, response: str, variables: list[str], family: Family, categories: set[str], ar: AR | None) -> Frame:
    """Complete rows, reduced to one row per distinct covariate combination if that saves rows.

    Year and day of year take a few thousand combinations in a record of any length, so every later
    pass reads those instead of the readings; the reduction loses nothing (see `family`).
    """
    made = [
        (F.expr(v).cast("string") if v in categories else F.expr(v).cast("double")).alias(f"x{i}")
        for i, v in enumerate(variables)
    ]
    extra = []
    if ar:
        extra = [F.expr(ar.by).alias("_by"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(ar.order)]]
    rows = df.select(F.expr(response).cast("double").alias("y"), *made, *extra)
    names = [f"x{i}" for i in range(len(variables))]
    rows = rows.na.drop(subset=["y", *names])  # drops NaN as well

    y = F.col("y")
    checked = family.total(F.when(y > 0, y)) if family.positive else family.total(y)
    combos = F.approx_count_distinct(F.xxhash64(*names)) if names else F.lit(1)
    stats = rows.agg(
        F.count("y").alias("n"),
        F.avg("y").alias("mean"),
        F.var_pop("y").alias("var"),
        F.min("y").alias("low"),
        checked.alias("total"),
        combos.alias("combos"),
    ).first()
    if not stats["n"]:
        raise ValueError("no complete rows to fit")
    if family.log_link and (stats["low"] < 0 or (family.positive and stats["low"] <= 0)):
        raise ValueError(f"{family.name} needs {'positive' if family.positive else 'non-negative'} responses")

    compressed = not family.by_row and stats["combos"] < 0.5 * stats["n"]
    if ar:
        cols = ["y", *names]
        shift = {
            f"{c}_{j}": (lambda w, c=c, j=j: F.lag(F.col(c), j).over(w))
            for j in range(1, ar.p + 1)
            for c in cols
        }
        order = [f"_o{i}" for i in range(len(ar.order))]
        cells = over_neighbours(rows, shift, order, ["_by"], before=ar.p, bounded=ar.bounded)
        cells = cells.drop("_by", *order).withColumnRenamed("y", "ybar")
        cells = cells.withColumns({"n": F.lit(1.0), "m2": F.lit(0.0)})
    elif compressed:
        cells = rows.groupBy(*names).agg(
            F.count("y").cast("double").alias("n"),
            F.avg("y").alias("ybar"),
            (F.var_pop("y") * F.count("y")).alias("m2"),
        )
        # stored: a lost executor then costs a small read, not another scan of the readings
        cells = settle(cells, "cells")
    else:
        cells = rows.select(*names, y.alias("ybar"), F.lit(1.0).alias("n"), F.lit(0.0).alias("m2"))
    # few large input splits would leave cores idle in every pass
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not compressed and not ar and cells.rdd.getNumPartitions() < cores:
        cells = cells.repartition(cores)
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    return Frame(
        cells, rows, variables, stats["n"], stats["mean"], stats["var"] * stats["n"],
        stats["total"], cells.rdd.getNumPartitions(), response, ar.p if ar else 0, compressed and not ar, stats["combos"],
    )


def build_design(frame: Frame, terms: Sequence[Term], select: bool) -> Design:
    """Knots from the covariates, then centring constraints from one pass of column sums."""
    level = _level_term(frame, terms)
    smooths, wanted = [], []
    for t in terms:
        if level and t is level.term:
            continue
        at = [frame.variables.index(v) for v in t.variables]
        own = [(f"x{c}", b, k, e) for c, b, k, e in zip(at, t.bs, t.k, t.ends or (None,) * len(at))]
        wanted.append(own)
        smooths.append(Smooth(t, at, [], [None] * len(at)))
    bases = marginals(frame.cells, [w for own in wanted for w in own])
    for sm, own in zip(smooths, wanted):
        sm.bases = [bases[w] for w in own]

    count = len(frame.variables)

    def column_sums(pdf: pd.DataFrame) -> np.ndarray:
        values = _values(pdf, count)
        n = pdf["n"].to_numpy()
        sums = []
        for sm in smooths:
            if sm.term.kind == "ti":
                sums += [n @ m for m in sm.margins(values)]
            elif sm.term.kind in ("s", "te"):
                sums.append(n @ sm.raw(values))
        return np.concatenate(sums) if sums else np.zeros(1)

    means = sum_over_rows(frame.cells, column_sums, frame.parts) / frame.n
    at = 0
    for sm in smooths:
        kind = sm.term.kind
        if kind == "ti":
            for i, b in enumerate(sm.bases):
                sm.margin_map[i] = contrast_to(means[at : at + b.size])
                at += b.size
            sm.penalties = tensor_penalties(sm.bases, sm.margin_map)
        elif kind in ("s", "te"):
            size = sm.raw_size
            sm.contrast = contrast_to(means[at : at + size])
            at += size
            raw = tensor_penalties(sm.bases, sm.margin_map)
            sm.penalties = [sm.contrast.T @ p @ sm.contrast for p in raw]
        elif kind == "re":
            sm.penalties = [np.eye(sm.raw_size)]
        if select and kind in ("s", "te", "ti"):
            free = null_space_penalty(sm.penalties)
            if free is not None:
                sm.penalties = [*sm.penalties, free]
    if level:
        named = {t.label for t in terms[: list(terms).index(level.term)]}
        level.before = sum(len(sm.penalties) for sm in smooths if sm.label in named)
    return Design(smooths, frame.variables, level).place()


def _level_term(frame: Frame, terms: Sequence[Term]) -> LevelTerm | None:
    """The random effect to keep as a table: of several the one with most levels. With AR errors a row mixes the levels of
    earlier rows, so random effects are columns there."""
    effects = [LevelTerm(t, frame.variables.index(t.variables[0])) for t in terms if t.kind == "re"]
    if not effects or frame.lags:
        return None
    if len(effects) == 1:
        return effects[0]
    counts = frame.cells.agg(*[F.count_distinct(f"x{e.column}") for e in effects]).first()
    return max(zip(counts, range(0, -len(effects), -1), effects))[2]


# --- one pass over the rows --------------------------------------------------------------------


@dataclass
class Pass:
    """What one pass over the rows returns, at the coefficients it was given."""

    gram: np.ndarray  # X'WX
    cross: np.ndarray  # X'Wz
    square: float  # z'Wz
    deviance: float
    pearson: float
    sums: tuple[float, float]
    lag_products: np.ndarray
    lag_counts: np.ndarray
    log_det: float
    rss: float  # on the response scale
    working_rss: float = 0.0  # weighted, of the working response (without AR errors)


def _values(pdf: pd.DataFrame, count: int, lag: int = 0) -> list:
    tail = f"_{lag}" if lag else ""
    return [pdf[f"x{i}{tail}"].to_numpy() for i in range(count)]


def _working(pdf: pd.DataFrame, design: Design, family: Family, beta: np.ndarray | None, lag: int = 0):
    """Design, response, mean, weight, working response and linear predictor of the rows (or of the rows `lag` before them)."""
    x = design.matrix(_values(pdf, len(design.variables), lag))
    y = pdf["ybar" if not lag else f"y_{lag}"].to_numpy()
    if beta is None:
        eta = family.start(y)
        mu, w, z = family.working(eta, y)
        w = np.ones_like(w) if family.by_row else w
    else:
        eta = x @ beta
        if "u" in pdf:
            eta = eta + pdf["u"].to_numpy()
        mu, w, z = family.working(eta, y)
    return x, y, mu, w, z, eta


def run_pass(
    frame: Frame, design: Design, family: Family, beta: np.ndarray | None, phi: Sequence[float] = (), cells: DataFrame | None = None
) -> Pass:
    """`cells` are those of the frame with the effect of a random level as column u, where there is one."""
    p, lags = design.size, frame.lags
    weights, ratios = innovations(phi) if len(phi) else ([], np.ones(1))

    def scaled_rows(pdf, lag=0):
        return _working(pdf, design, family, beta, lag)

    def partial(pdf: pd.DataFrame) -> np.ndarray:
        n, m2 = pdf["n"].to_numpy(), pdf["m2"].to_numpy()
        x, y, mu, w, z, eta = scaled_rows(pdf)
        nw = n * w
        deviance = float(np.sum(family.deviance(n, y, m2, mu)))
        pearson = float(np.sum(family.pearson(n, y, m2, mu)))
        s1, s2 = family.likelihood_terms(n, y, mu)
        within = m2 * w / (mu * mu) if family.log_link else m2 * w
        products, counts = np.zeros(lags + 1), np.zeros(lags + 1)
        log_det = 0.0
        if lags:
            root = np.sqrt(w)
            x, z, r = x * root[:, None], z * root, (z - eta) * root
            products[0], counts[0] = r @ r, len(r)
            depth = np.zeros(len(pdf), dtype=int)  # earlier rows of the same group, at most p
            x_new, z_new = x.copy(), z.copy()
            place = [np.flatnonzero(pdf[f"y_{j}"].notna().to_numpy()) for j in range(1, lags + 1)]
            for rows in place:
                depth[rows] += 1
            for j, rows in enumerate(place, start=1):
                if not len(rows):
                    continue
                xj, _, _, wj, zj, ej = scaled_rows(pdf.iloc[rows], j)
                rj = np.sqrt(wj)
                products[j] = r[rows] @ ((zj - ej) * rj)
                counts[j] = len(rows)
                if len(phi):
                    a = np.array([weights[d][j - 1] for d in depth[rows]])
                    x_new[rows] -= (a * rj)[:, None] * xj
                    z_new[rows] -= a * rj * zj
            if len(phi):
                v = ratios[np.minimum(depth, lags)]
                x, z = x_new / np.sqrt(v)[:, None], z_new / np.sqrt(v)
                log_det = float(np.sum(np.log(v)))
            gram, cross, square = x.T @ x, x.T @ z, float(z @ z)
            working_rss = 0.0
        else:
            xw = x * nw[:, None]
            gram, cross = x.T @ xw, xw.T @ z
            square = float(nw @ (z * z) + within.sum())
            working_rss = float(nw @ ((z - eta) ** 2) + within.sum())
        rss = float(np.sum(m2 + n * (y - mu) ** 2))
        head = [square, deviance, pearson, s1, s2, log_det, rss, working_rss]
        return np.concatenate([head, products, counts, cross, gram.ravel()])

    total = sum_over_rows(frame.cells if cells is None else cells, partial, frame.parts)
    square, deviance, pearson, s1, s2, log_det, response_rss, working_rss = total[:8]
    rest = total[8:]
    products, counts, rest = rest[: lags + 1], rest[lags + 1 : 2 * lags + 2], rest[2 * lags + 2 :]
    return Pass(
        rest[p:].reshape(p, p), rest[:p], square, deviance + family.deviance_constant(frame.total),
        pearson, (s1, s2), products, counts, log_det, response_rss, working_rss,
    )


# --- smoothing parameters on the driver --------------------------------------------------------


@dataclass
class Penalty:
    block: slice
    matrix: np.ndarray


def penalties_of(design: Design, gram: np.ndarray) -> list[Penalty]:
    """All penalties, scaled to the size of their block of the cross-product matrix."""
    out = []
    for sm in design.smooths:
        size = np.linalg.norm(gram[sm.block, sm.block])
        for s in sm.penalties:
            out.append(Penalty(sm.block, s * (size / np.linalg.norm(s))))
    return out


def penalty_range(design: Design) -> np.ndarray:
    """Orthonormal basis of the penalised directions of the whole coefficient vector."""
    columns = []
    for sm in design.smooths:
        if not sm.penalties:
            continue
        values, vectors = np.linalg.eigh(sum(s / np.linalg.norm(s) for s in sm.penalties))
        kept = vectors[:, values > values.max() * 1e-10]
        full = np.zeros((design.size, kept.shape[1]))
        full[sm.block] = kept
        columns.append(full)
    return np.hstack(columns) if columns else np.zeros((design.size, 0))


def total_penalty(size: int, penalties: list[Penalty], lam: np.ndarray) -> np.ndarray:
    s = np.zeros((size, size))
    for value, p in zip(lam, penalties):
        s[p.block, p.block] += value * p.matrix
    return s


def safe_inverse(h: np.ndarray) -> np.ndarray:
    d = 1 / np.sqrt(np.maximum(np.diag(h), 1e-300))
    scaled = h * np.outer(d, d)
    try:
        root = np.linalg.cholesky(scaled)
        if np.diag(root).min() < 1e-7:
            raise np.linalg.LinAlgError
        inv = np.linalg.inv(root)
        return (inv.T @ inv) * np.outer(d, d)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) * np.outer(d, d)


class PenalisedInverse:
    """(A + S)^-1, formed in the axes of the penalty of each block: there even a huge penalty only scales a row and a
    column, so what it leaves free keeps its digits."""

    def __init__(self, size: int, penalties: list[Penalty]):
        self.size = size
        self.blocks = {(p.block.start, p.block.stop) for p in penalties}
        single = {b: [p for p in penalties if (p.block.start, p.block.stop) == b] for b in self.blocks}
        self.known = {b: np.linalg.eigh(own[0].matrix)[1] for b, own in single.items() if len(own) == 1}

    def __call__(self, gram: np.ndarray, s: np.ndarray) -> np.ndarray:
        axes, values = np.eye(self.size), np.zeros(self.size)
        for block in self.blocks:
            own = slice(*block)
            if block in self.known:
                axes[own, own] = a = self.known[block]
                v = np.einsum("ij,ij->j", a, s[own, own] @ a)
            else:
                v, axes[own, own] = np.linalg.eigh(s[own, own])
            values[own] = np.where(v > v.max() * 1e-14, v, 0.0)
        return axes @ safe_inverse(axes.T @ gram @ axes + np.diag(values)) @ axes.T


@dataclass
class Solution:
    beta: np.ndarray
    lam: np.ndarray
    edf: np.ndarray  # per coefficient
    inverse: np.ndarray  # (A + S)^-1
    scale: float
    score: float
    gradient: float = 0.0  # largest of the score in a log smoothing parameter, at the scale


#: Bounds of that gradient: where the updates end, and above which a fit has not converged.
GRADIENT, LARGE_GRADIENT = 1e-6, 1e-3
UPDATES = 300


def choose_smoothing(r: Pass, n: int, penalties, lam, span, method: str, fixed: bool, scale: float | None = None) -> Solution:
    """Update every smoothing parameter on the current cross-products until the gradient of the score is zero within GRADIENT. A
    parameter at an end of its range that would leave it counts as settled. Steps that the last two make predictable are lengthened, and
    taken back to plain ones where that raises the score."""
    size = len(r.cross)
    restricted = [span.T[:, p.block] @ p.matrix @ span[p.block] for p in penalties]
    unpenalised = size - span.shape[1]
    invert = PenalisedInverse(size, penalties)
    low, high = np.log(LAMBDA_RANGE)

    def at(lam):
        s = total_penalty(size, penalties, lam)
        inverse = invert(r.gram, s)
        beta = inverse @ r.cross
        edf = np.einsum("ij,ji->i", inverse, r.gram)
        rss = max(r.square - 2 * beta @ r.cross + beta @ r.gram @ beta, 1e-300)
        phi = scale or rss / max(n - edf.sum(), 1.0)
        return s, Solution(beta, lam, edf, inverse, phi, _score(r, n, beta, s, span, unpenalised, rss, phi, method))

    s, sol = at(lam.copy())
    if fixed or not penalties:
        return sol
    last = None  # the step before, where that was a plain one
    for _ in range(UPDATES):
        prior = safe_inverse(span.T @ s @ span)
        posterior = sol.inverse if method == "REML" else span @ safe_inverse(span.T @ (r.gram + s) @ span) @ span.T
        gains = [np.sum(prior * q) - np.sum(posterior[p.block, p.block] * p.matrix) for p, q in zip(penalties, restricted)]
        sizes = [sol.beta[p.block] @ p.matrix @ sol.beta[p.block] for p in penalties]
        gains, sizes, logs = np.maximum(gains, 1e-12), np.maximum(sizes, 1e-300), np.log(sol.lam)
        step = np.clip(np.log(sol.scale * gains / sizes), -np.log(1e3), np.log(1e3))
        settled = ((logs >= high) & (step > 0)) | ((logs <= low) & (step < 0))
        slopes = np.where(settled, 0.0, 0.5 * sol.lam * (sizes / sol.scale - gains))
        sol.gradient = float(np.abs(slopes).max())
        if sol.gradient < GRADIENT:
            break
        longer = step
        if last is not None:
            # steps that shrink by a constant factor add up to a geometric series
            factor = np.where(np.abs(last) > 1e-12, step / np.where(last == 0, 1, last), 0)
            longer = np.where((factor > 0) & (factor < 0.98), step / (1 - factor), step)
        new_s, new = at(np.exp(np.clip(logs + np.clip(longer, -np.log(1e3), np.log(1e3)), low, high)))
        if longer is not step and new.score > sol.score + 1e-9:
            longer = step
            new_s, new = at(np.exp(np.clip(logs + step, low, high)))
        last = step if longer is step else None
        s, sol = new_s, new
    return sol


def _score(r, n, beta, s, span, unpenalised, rss, phi, method) -> float:
    """Restricted (or plain) marginal likelihood of the working model, negative log."""
    h = r.gram + s
    if method == "ML":
        log_h, free = np.linalg.slogdet(span.T @ h @ span)[1] if span.shape[1] else 0.0, 0
    else:
        log_h, free = np.linalg.slogdet(h)[1], unpenalised
    log_s = np.linalg.slogdet(span.T @ s @ span)[1] if span.shape[1] else 0.0
    return 0.5 * ((rss + beta @ s @ beta) / phi + log_h - log_s + (n - free) * np.log(2 * np.pi * phi))


# --- the user's call ---------------------------------------------------------------------------


def gam(
    df: DataFrame,
    response: str,
    terms: Sequence[Term],
    family: str | Family = "gaussian",
    method: str = "REML",
    select: bool = False,
    power: float | str = "estimate",
    nu: float | str = "estimate",
    ar: AR | None = None,
    lam: Sequence[float] | float | None = None,
    na: str = "exclude",
) -> GamModel:
    """Fit a penalised additive model.

    `response` and the variables of the terms are SQL expressions. `method` is 'REML' or 'ML'.
    `select` adds a penalty on what each smooth leaves unpenalised. `power` fixes the power of a Tweedie
    response, `nu` the degrees of freedom of a scaled t response; both are estimated by default.
    `ar` gives autoregressive errors. `lam` fixes the smoothing parameters. Rows with a missing value
    are left out (`na='exclude'`) or refused (`na='fail'`).
    """
    if method not in ("REML", "ML"):
        raise ValueError(f"method must be REML or ML, not {method!r}")
    variables = list(dict.fromkeys(v for t in terms for v in t.variables))
    categories = {t.variables[0] for t in terms if t.kind == "re"}
    estimate_power = family == "tweedie" and power == "estimate"
    estimate_nu = family == "scaled_t" and nu == "estimate"
    if isinstance(family, str):
        if family not in FAMILIES:
            raise ValueError(f"unknown family {family!r}; known: {sorted(FAMILIES)}")
        settings = {}
        if family == "tweedie":
            settings["power"] = 1.5 if estimate_power else float(power)
        if family == "scaled_t":
            settings["nu"] = 5.0 if estimate_nu else float(nu)
        family = FAMILIES[family](**settings)
    if na == "fail":
        # NaN is missing too; text has none
        wanted = [F.expr(v).isNull() | F.isnan(F.expr(v).try_cast("double")) for v in [response, *variables]]
        missing = wanted[0]
        for w in wanted[1:]:
            missing = missing | w
        if df.where(missing).limit(1).count():
            raise ValueError("missing values in the rows to fit")

    frame = prepare(df, response, variables, family, categories, ar)
    try:
        return fit_frame(frame, terms, family, method, select, ar, lam, estimate_power, estimate_nu)
    finally:
        frame.cells.unpersist()


def fit_frame(frame, terms, family, method, select, ar, lam, estimate_power=False, estimate_nu=False, design=None):
    design = design or build_design(frame, terms, select)
    settings = dict(frame=frame, design=design, method=method, lam=lam)
    if estimate_power:
        model = _best_power(settings, family)
    elif estimate_nu:
        model = _best_nu(settings)
    elif ar and ar.p:
        model = _with_ar(settings, family, ar)
    else:
        model = _iterate(family=family, **settings)
    model.terms, model.select, model.ar = list(terms), select, ar
    return model


class _Columns:
    """The normal equations with a column for every coefficient."""

    def __init__(self, frame: Frame, design: Design, family: Family, method: str, phi):
        self.frame, self.design, self.family, self.method, self.phi = frame, design, family, method, phi
        self.effects = None

    def read(self, beta, effects=None) -> Pass:
        return run_pass(self.frame, self.design, self.family, beta, self.phi)

    def prepare(self, r: Pass, lam) -> None:
        self.penalties, self.span = penalties_of(self.design, r.gram), penalty_range(self.design)
        self.fixed = lam is not None
        count = len(self.penalties)
        self.lam = np.full(count, 1.0 if lam is None else float(lam)) if lam is None or np.isscalar(lam) else np.asarray(lam, dtype=float)

    def choose(self, r: Pass, known=None, final=False) -> Solution:
        sol = choose_smoothing(r, self.frame.n, self.penalties, self.lam, self.span, self.method, self.fixed or final, known)
        self.lam = sol.lam
        return sol

    def proposal(self, sol: Solution):
        return sol.beta, None

    def halfway(self, old, new):
        return (old[0] + new[0]) / 2, None

    def penalty(self, beta, effects) -> float:
        return float(beta @ total_penalty(self.design.size, self.penalties, self.lam) @ beta)

    def edf(self, sol: Solution) -> float:
        return float(sol.edf.sum())

    def residual(self, r: Pass, sol: Solution) -> float:
        """Residual sum of squares of a linear model, from its cross-products."""
        return r.square - 2 * sol.beta @ r.cross + sol.beta @ r.gram @ sol.beta

    def fitted(self, r: Pass, sol: Solution, scale: float):
        """The pass and what the model knows about its levels."""
        return r, None, sol.lam


class _Levels(_Columns):
    """The normal equations with a random effect kept as a table of its levels."""

    def read(self, beta, effects=None) -> Pass:
        self.at = beta, with_offset(self.frame.cells, self.design.level, effects)
        return run_pass(self.frame, self.design, self.family, beta, cells=self.at[1])

    def prepare(self, r: Pass, lam) -> None:
        self.given = None
        if lam is not None:
            self.given = float(lam if np.isscalar(lam) else lam[self.design.level.before])
            lam = lam if np.isscalar(lam) else np.delete(np.asarray(lam, dtype=float), self.design.level.before)
        super().prepare(r, lam)
        self.ratio, self.near = None, None

    def choose(self, r: Pass, known=None, final=False) -> Solution:
        design, family, (beta, cells) = self.design, self.family, self.at

        def weighted(pdf):
            x, _, _, w, z, _ = _working(pdf, design, family, beta)
            return x, pdf["n"].to_numpy() * w, z

        arrow = self.arrow = Arrow(r, level_sums(cells, design.level, weighted, design.size), design.size, self.frame.parts)

        def solve(reduced):
            return choose_smoothing(reduced, self.frame.n, self.penalties, self.lam, self.span, self.method, self.fixed or final, known)

        def posterior(reduced, sol):
            if self.method == "REML":
                return sol.inverse
            h = reduced.gram + total_penalty(design.size, self.penalties, sol.lam)
            return self.span @ safe_inverse(self.span.T @ h @ self.span) @ self.span.T

        if final and self.ratio is not None:
            self.choice = arrow.at(arrow.reduced(np.array([self.ratio])), 0, solve, posterior)
        else:
            self.choice = arrow.choose(solve, posterior, self.given, self.near)
            # next time the search starts around here, within a few times the last move
            log, last = np.log(self.choice.ratio), self.near and self.near[0]
            self.near = log, 1.0 if last is None else float(np.clip(4 * abs(log - last), 1e-3, 1.0))
        self.ratio = self.choice.ratio
        sol = self.choice.solution
        self.lam = sol.lam
        return replace(sol, score=self.choice.score)

    def proposal(self, sol: Solution):
        self.square = self.choice.square
        return sol.beta, self.arrow.effects(sol.beta, self.choice.ratio)

    def halfway(self, old, new):
        effects = halfway(old[1], new[1])
        self.square = effects.agg(F.sum(F.col("u") * F.col("u"))).first()[0]
        return (old[0] + new[0]) / 2, effects

    def penalty(self, beta, effects) -> float:
        square = 0.0 if effects is None else effects.agg(F.sum(F.col("u") * F.col("u"))).first()[0]
        return super().penalty(beta, effects) + self.ratio * square

    def edf(self, sol: Solution) -> float:
        return float(sol.edf.sum()) + self.choice.edf

    def residual(self, r: Pass, sol: Solution) -> float:
        return super().residual(self.choice.reduced, sol) - self.choice.ratio * self.choice.square

    def fitted(self, r: Pass, sol: Solution, scale: float):
        c = self.choice
        reduced = replace(r, gram=c.reduced.gram, cross=c.reduced.cross, square=c.reduced.square)
        effects = self.arrow.effects(sol.beta, c.ratio, scale)
        level = LevelFit(self.design.level, effects, self.arrow.count, c.edf, c.ratio, c.square, c.log_det, r.gram)
        return reduced, level, np.insert(sol.lam, self.design.level.before, c.ratio / self.arrow.root_mean_square)


def _iterate(frame: Frame, design: Design, family: Family, method: str, lam=None, beta=None, phi=()) -> GamModel:
    system = (_Levels if design.level else _Columns)(frame, design, family, method, phi)
    at = beta, None  # coefficients and level effects
    r = system.read(*at)
    system.prepare(r, lam)
    if isinstance(family, ScaledT) and family.sigma is None:
        first = system.choose(r)
        family.sigma, at = float(np.sqrt(first.scale)), system.proposal(first)
        r = system.read(*at)

    previous, sol, converged, gradient = None, None, False, 0.0
    for step in range(MAX_STEPS):
        known = family.sigma**2 if isinstance(family, ScaledT) else None
        sol = system.choose(r, known)
        gradient = sol.gradient
        if family.name == "gaussian":
            # linear in the response: the cross-products already give the deviance
            at, converged = (sol.beta, None), True
            if not frame.lags:
                rss = system.residual(r, sol)
                r = replace(r, deviance=rss, pearson=rss, rss=rss)
            else:
                r = run_pass(frame, design, family, sol.beta, phi)
            break
        proposal = system.proposal(sol)
        new = system.read(*proposal)
        if at[0] is not None and not len(phi):
            old_value = r.deviance + system.penalty(*at)
            for _ in range(8):
                if np.isfinite(new.deviance) and new.deviance + system.penalty(*proposal) <= old_value * (1 + 1e-6) + 1e-8:
                    break
                proposal = system.halfway(at, proposal)
                new = system.read(*proposal)
        at, r = proposal, new
        if isinstance(family, ScaledT):
            family.sigma = float(np.sqrt(r.working_rss / frame.n))
        value = r.deviance
        log.debug("step %d deviance %.8g edf %.3f", step, value, system.edf(sol))
        if previous is not None and abs(value - previous) <= TOLERANCE * (abs(value) + 0.1):
            converged = True
            break
        previous = value
    converged = converged and gradient < LARGE_GRADIENT
    if not converged:
        log.warning("no convergence: %d steps, deviance %.8g, gradient of the smoothing parameters %.2g", step + 1, r.deviance, gradient)
    known = family.sigma**2 if isinstance(family, ScaledT) else None
    beta = at[0]
    final = system.choose(r, known, final=True)
    edf = system.edf(final)
    if len(phi):
        scale = final.scale
    elif isinstance(family, ScaledT):
        scale = family.sigma**2
    else:
        scale = r.pearson / max(frame.n - edf, 1.0)
    s = total_penalty(design.size, system.penalties, final.lam)
    last, level, lams = system.fitted(r, final, scale)
    return GamModel(
        frame=frame, design=design, family=family, method=method, beta=beta, lam=lams,
        covariance=scale * final.inverse, edf_coef=final.edf, scale=float(scale), last=last,
        penalty=s, penalty_span=system.span, inverse=final.inverse, phi=np.asarray(phi, dtype=float),
        working_score=final.score, level=level, converged=converged, gradient=gradient,
    )


#: Values of a family parameter tried in one pass, and the width of the interval at which its search ends.
TRIED, NARROW = 17, 1e-5
POWERS = (1.01, 1.99)
#: Degrees of freedom of a scaled t, searched on the log scale.
DEGREES = (1.5, 1000.0)


def search(value, low: float, high: float, width: float = NARROW) -> float:
    """Where `value` (of an array of points) is greatest: the interval around the best of TRIED points is cut again and
    again; a parabola through the last three points ends the search. An end of the interval is returned as it is."""
    ends = low, high
    while True:
        points = np.linspace(low, high, TRIED)
        values = value(points)
        best = int(np.argmax(values))
        if points[best] in ends:
            low, high = (points[0], points[1]) if best == 0 else (points[-2], points[-1])
            if high - low <= width:
                return float(points[best])
            continue
        a, m, c = points[best - 1 : best + 2]
        if c - a <= max(width, 1e-3 * (ends[1] - ends[0])):
            fa, fm, fc = values[best - 1 : best + 2]
            bend = fa - 2 * fm + fc
            return float(m + (0.5 * (m - a) * (fa - fc) / bend if bend < 0 else 0.0))
        low, high = a, c


def _means(model: GamModel, partial) -> np.ndarray:
    """Sums of `partial(n, ybar, m2, mu)` over the cells at the fitted means."""
    frame, design, family, beta = model.frame, model.design, model.family, model.beta
    cells = with_offset(frame.cells, design.level, model.level.effects) if model.level else frame.cells

    def run(pdf: pd.DataFrame) -> np.ndarray:
        _, y, mu, *_ = _working(pdf, design, family, beta)
        return partial(pdf["n"].to_numpy(), y, pdf["m2"].to_numpy(), mu)

    return sum_over_rows(cells, run, frame.parts)


def _best_power(settings, family) -> GamModel:
    """Power of a Tweedie response by likelihood: the likelihood of all powers of a bracket is summed in one pass at the fitted
    means, the best one is refitted from there, until the power stays."""
    frame = settings["frame"]
    values = settle(frame.rows.groupBy("y").agg(F.count(F.lit(1)).cast("double").alias("n")), "responses")

    def fitted(power: float, beta) -> GamModel:
        new = Tweedie(power)
        own = replace(frame, total=values.agg(F.sum(F.col("n") * F.pow("y", F.lit(2 - power)))).first()[0])
        return _iterate(**{**settings, "frame": own}, family=new, beta=beta)

    def likelihood(model: GamModel, powers: np.ndarray) -> np.ndarray:
        tried = [Tweedie(p) for p in powers]

        def sums(n, y, m2, mu):
            return np.array([[t.likelihood_terms(n, y, mu)[0], np.sum(t.pearson(n, y, m2, mu))] for t in tried]).ravel()

        kernel, pearson = _means(model, sums).reshape(-1, 2).T
        scales = pearson / max(model.n - model.edf, 1.0)

        def base(pdf: pd.DataFrame) -> np.ndarray:
            return np.array([pdf["n"].to_numpy() @ t.log_base(pdf["y"].to_numpy(), scale) for t, scale in zip(tried, scales)])

        return sum_over_rows(values, base, frame.parts) + kernel / scales

    power, model = 1.5, fitted(1.5, None)
    for _ in range(MAX_STEPS):
        new = search(lambda p: likelihood(model, p), *POWERS)
        moved, power = abs(new - power), new
        model = fitted(power, model.beta)
        if moved < 1e-4:
            break
    else:
        model.converged = False
    if power in POWERS:
        log.warning("the power lies at the edge of its range, %g", power)
    return model


def _best_nu(settings) -> GamModel:
    """Degrees of freedom of a scaled t response by likelihood, alternating with the fit. At the fitted means one pass sums the
    likelihood over a grid of degrees and scales, which move together; the grid closes in on the best of its points."""
    side = 9
    ends = np.log(DEGREES)

    def likelihood(model: GamModel, nus: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
        def depth(n, y, m2, mu):
            square = (y - mu) ** 2
            return np.array([np.sum(n * np.log1p(square / (s * s * nu))) for nu in nus for s in sigmas])

        nu, sigma = np.repeat(nus, side), np.tile(sigmas, side)
        constant = lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * math.pi) - np.log(sigma)
        return model.n * constant - (nu + 1) / 2 * _means(model, depth)

    def best(model: GamModel) -> np.ndarray:
        middle = np.array([ends.mean(), math.log(model.family.sigma)])
        half = np.array([(ends[1] - ends[0]) / 2, 1.0])
        while half.max() > NARROW:
            low, high = middle - half, middle + half
            low[0], high[0] = max(low[0], ends[0]), min(high[0], ends[1])
            axes = [np.linspace(low[i], high[i], side) for i in (0, 1)]
            at = np.unravel_index(np.argmax(likelihood(model, *map(np.exp, axes))), (side, side))
            middle = np.array([axes[i][at[i]] for i in (0, 1)])
            inside = [0 < at[i] < side - 1 or middle[i] in ends for i in (0, 1)]
            half = np.where(inside, (high - low) / (side - 1), half)
        return middle

    log_nu, model = math.log(5.0), _iterate(family=ScaledT(5.0), **settings)
    for _ in range(MAX_STEPS):
        new, log_sigma = best(model)
        moved, log_nu = abs(new - log_nu), float(new)
        model = _iterate(family=ScaledT(math.exp(log_nu), math.exp(log_sigma)), beta=model.beta, **settings)
        if moved < 1e-4:
            break
    else:
        model.converged = False
    if log_nu in ends:
        log.warning("the degrees of freedom lie at the edge of their range, %g", math.exp(log_nu))
    return model


def _with_ar(settings, family, ar: AR) -> GamModel:
    """Alternate between the coefficients and the AR parameters of the working residuals."""
    if ar.phi:
        if len(ar.phi) != ar.p:
            raise ValueError(f"{ar.p} AR coefficients are needed, not {len(ar.phi)}")
        return _iterate(family=family, phi=np.asarray(ar.phi, dtype=float), **settings)
    model = _iterate(family=family, **settings)
    phi = np.zeros(ar.p)
    for _ in range(20):
        new = yule_walker(model.last.lag_products, model.last.lag_counts)
        if np.max(np.abs(new - phi)) < 1e-4:
            break
        phi = new
        model = _iterate(family=family, beta=model.beta, phi=phi, **settings)
    return model


def yule_walker(products: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """AR coefficients from sums of lagged residual products; kept inside the stationary region."""
    rho = (products / np.maximum(counts, 1)) / (products[0] / counts[0])
    p = len(rho) - 1
    phi = np.zeros(0)
    v = 1.0
    for k in range(1, p + 1):
        a = (rho[k] - np.dot(phi, rho[k - 1 : 0 : -1][: len(phi)])) / v
        a = float(np.clip(a, -0.98, 0.98))
        phi = np.concatenate([phi - a * phi[::-1], [a]])
        v *= 1 - a * a
    return phi
