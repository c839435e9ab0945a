"""A random effect with any number of levels, fitted next to the other terms.

One column per level would need a matrix of levels x levels. But the cross-products of the level columns are diagonal (a row has one
level), so the normal equations have the shape of an arrow: the small matrix of the other terms, a diagonal, and one row of
sums per level. The sums are a table with a row per level, made by one `groupBy`; eliminating the levels (Schur
complement) leaves the small system, whose corrections are sums over that table:

    X'WX - sum_l b_l b_l' / (d_l + ratio),    X'Wz - sum_l b_l c_l / (d_l + ratio),

with d, c, b a level's sums of weights, of weight times response and of weight times the other terms. One pass over the table
gives them for many values of the ratio (residual to level variance) at once, so the ratio is found by cutting an interval where the
REML (or ML) condition changes its sign. Nothing that grows with the levels reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.session import settle
from tarnis.smooth.sums import sum_over_rows

#: Ratios tried in one pass, and the span of their logarithm around that of the mean weight of a level.
TRIED, SPAN = 17, 18.0
#: Width of the interval of the log ratio at which the search ends; the last step is linear.
NARROW = 1e-4


@dataclass
class LevelTerm:
    """The random effect of a design: its term and the place of its covariate."""

    term: object
    column: int
    before: int = 0  # penalties of terms named before it

    @property
    def label(self) -> str:
        return self.term.label


@dataclass
class LevelFit:
    """What a fitted model knows about its levels."""

    term: LevelTerm
    effects: DataFrame  # level, u (effect), g (share of each other coefficient), v (own variance)
    count: int
    edf: float
    ratio: float
    square: float  # sum of squared effects
    log_det: float  # log det (D + ratio) - count * log ratio
    gram: np.ndarray  # X'WX of the other terms, nothing eliminated

    @property
    def penalty(self) -> float:
        return self.ratio * self.square


@dataclass
class Reduced:
    """Sums over the levels at several ratios."""

    ratios: np.ndarray
    first: np.ndarray  # sums with 1 / (d + ratio): matrix of (b, c)
    second: np.ndarray  # with its square
    trace: np.ndarray
    log_det: np.ndarray


@dataclass
class Choice:
    """A solution at one ratio."""

    solution: object
    reduced: object  # the pass without the levels
    ratio: float
    edf: float
    square: float
    log_det: float
    target: float  # the ratio that the current effects call for
    score: float


def level_sums(cells: DataFrame, term: LevelTerm, weighted, size: int) -> DataFrame:
    """Table (level, d, c, b) of the sums of each level. `weighted(pdf)` gives design, weight and working response of a batch.

    Each batch adds up its own levels first, so a level that holds a third of the rows sends one row per batch.
    """
    column, count = f"x{term.column}", size + 2

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, w, z = weighted(pdf)
            codes, levels = pd.factorize(pdf[column])
            sums = np.zeros((len(levels), count))
            np.add.at(sums, codes, np.column_stack([w, w * z, x * w[:, None]]))
            yield pd.DataFrame({"level": levels, **{f"s{i}": sums[:, i] for i in range(count)}})

    schema = "level string, " + ", ".join(f"s{i} double" for i in range(count))
    sums = cells.mapInPandas(partial, schema).groupBy("level").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(count)])
    made = sums.select("level", F.col("s0").alias("d"), F.col("s1").alias("c"), F.array(*[f"s{i}" for i in range(2, count)]).alias("b"))
    return settle(made, "levels")


class Arrow:
    """The sums of one pass: those of the other terms (a `Pass`) and the table of levels."""

    def __init__(self, r, table: DataFrame, size: int, parts: int):
        self.r, self.table, self.size, self.parts = r, table, size, parts
        n, d, dd = table.agg(F.count(F.lit(1)), F.sum("d"), F.sum(F.col("d") * F.col("d"))).first()
        self.count, self.mean, self.root_mean_square = n, d / n, float(np.sqrt(dd / n))

    def reduced(self, ratios: np.ndarray) -> Reduced:
        k = self.size + 1

        def partial(pdf: pd.DataFrame) -> np.ndarray:
            d = pdf["d"].to_numpy()
            bc = np.column_stack([np.vstack(pdf["b"].to_list()), pdf["c"].to_numpy()])
            out = []
            for ratio in ratios:
                share = 1 / (d + ratio)
                scaled = bc * share[:, None]
                out += [(bc.T @ scaled).ravel(), (scaled.T @ scaled).ravel(), [share.sum(), np.log(d + ratio).sum()]]
            return np.concatenate(out)

        total = sum_over_rows(self.table, partial, self.parts).reshape(len(ratios), -1)
        first, second = total[:, : k * k].reshape(-1, k, k), total[:, k * k : 2 * k * k].reshape(-1, k, k)
        return Reduced(ratios, first, second, total[:, -2], total[:, -1])

    def at(self, sums: Reduced, i: int, solve, posterior) -> Choice:
        """Solution at the i-th ratio. `solve(pass)` gives the small system's solution, `posterior(pass, solution)` the covariance that
        counts for the ratio's condition (that of all other coefficients for REML, of the penalised ones for ML)."""
        ratio, first, second = float(sums.ratios[i]), sums.first[i], sums.second[i]
        r = replace(self.r, gram=self.r.gram - first[:-1, :-1], cross=self.r.cross - first[:-1, -1], square=self.r.square - float(first[-1, -1]))
        sol = solve(r)
        step = np.append(-sol.beta, 1.0)  # e = c - b beta
        square = float(step @ second @ step)
        trace = lambda inverse: self.count - ratio * (sums.trace[i] + np.sum(inverse * second[:-1, :-1]))
        target = sol.scale * max(trace(posterior(r, sol)), 1e-12) / max(square, 1e-300)
        log_det = float(sums.log_det[i] - self.count * np.log(ratio))
        return Choice(sol, r, ratio, float(trace(sol.inverse)), square, log_det, target, sol.score + log_det / 2)

    def choose(self, solve, posterior, fixed: float | None, near: tuple[float, float] | None = None) -> Choice:
        """The ratio where the condition holds: the one with the best score if there are several, an end of the span if there
        is none. `near` gives a log ratio and how far from it to look first."""
        if fixed is not None:
            return self.at(self.reduced(np.array([fixed * self.root_mean_square])), 0, solve, posterior)
        middle, width = near or (np.log(self.mean), SPAN)
        low, high = middle - width, middle + width
        while True:
            logs = np.linspace(low, high, TRIED)
            sums = self.reduced(np.exp(logs))
            tried = [self.at(sums, i, solve, posterior) for i in range(TRIED)]
            gaps = np.array([np.log(t.target) for t in tried]) - logs
            falls = [i for i in range(TRIED - 1) if gaps[i] >= 0 > gaps[i + 1]]
            if not falls:
                return self.choose(solve, posterior, fixed) if near else min(tried, key=lambda t: t.score)
            i = min(falls, key=lambda j: min(tried[j].score, tried[j + 1].score))
            if near or high - low <= NARROW * TRIED:
                root = logs[i] + (logs[i + 1] - logs[i]) * gaps[i] / (gaps[i] - gaps[i + 1])
                return self.at(self.reduced(np.array([np.exp(root)])), 0, solve, posterior)
            low, high = logs[i], logs[i + 1]

    def effects(self, beta: np.ndarray, ratio: float, scale: float = 1.0) -> DataFrame:
        """The level effects and what their variance needs, stored."""
        e = F.col("c") - _dot(F.col("b"), beta)
        share = F.lit(1.0) / (F.col("d") + F.lit(float(ratio)))
        made = self.table.select(
            "level", (e * share).alias("u"), F.transform("b", lambda x: x * share).alias("g"), (F.lit(float(scale)) * share).alias("v"), "d"
        )
        return settle(made, "effects")


def _dot(column: Column, numbers: np.ndarray) -> Column:
    products = F.zip_with(column, F.array(*[F.lit(float(x)) for x in numbers]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def with_offset(cells: DataFrame, term: LevelTerm, effects: DataFrame | None) -> DataFrame:
    """The cells with the effect of their level as column u."""
    if effects is None:
        return cells
    return cells.join(effects.select("level", "u"), cells[f"x{term.column}"] == F.col("level"), "left").drop("level")


def halfway(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Effects in the middle between two tables of the same levels (no table: zero)."""
    if old is None:
        return settle(new.withColumn("u", F.col("u") / 2), "effects")
    before = old.select(F.col("level").alias("_l"), F.col("u").alias("_u"))
    return settle(new.join(before, F.col("level") == F.col("_l")).withColumn("u", (F.col("u") + F.col("_u")) / 2).drop("_l", "_u"), "effects")
