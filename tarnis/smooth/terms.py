"""Model terms: what the user writes (`s`, `te`, `ti`, `re`) and the design it becomes.

Variables are SQL expressions, so `s("sqrt(SRP)")` works without adding a column first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.operators.quantiles import evenly_ranked, order_statistics
from tarnis.smooth.levels import LevelTerm
from tarnis.smooth.bases import CubicBasis, LevelBasis, LineBasis, ThinPlateBasis

CENTRES = 200  # centres of a thin plate basis


@dataclass(frozen=True)
class Term:
    kind: str  # s, te, ti, re, linear
    variables: tuple[str, ...]
    bs: tuple[str, ...]
    k: tuple[int, ...]
    ends: tuple = ()  # per variable: (low, high) or None

    @property
    def label(self) -> str:
        name = "s" if self.kind == "re" else self.kind
        return self.variables[0] if self.kind == "linear" else f"{name}({','.join(self.variables)})"


def _each(value, n):
    return tuple(value) if isinstance(value, (tuple, list)) else (value,) * n


def _ends(variables, bs, knots):
    knots = dict(knots or {})
    ends = tuple(knots.get(v) for v in variables)
    for v, b, e in zip(variables, bs, ends):
        if b == "cc" and e is None:
            raise ValueError(f"a cyclic basis needs its end knots: knots={{'{v}': (low, high)}}")
    return ends


def s(variable: str, bs: str = "tp", k: int = 10, knots: Mapping | None = None) -> Term:
    """Smooth of one variable. bs: 'tp' thin plate, 'cr' cubic, 'cc' cyclic with given end knots."""
    return Term("s", (variable,), (bs,), (k,), _ends((variable,), (bs,), knots))


def te(*variables: str, bs="cr", k=5, knots: Mapping | None = None) -> Term:
    """Tensor product smooth, main effects included."""
    n = len(variables)
    return Term("te", variables, _each(bs, n), _each(k, n), _ends(variables, _each(bs, n), knots))


def ti(*variables: str, bs="cr", k=5, knots: Mapping | None = None) -> Term:
    """Tensor product interaction only (or a main effect, with one variable)."""
    n = len(variables)
    return Term("ti", variables, _each(bs, n), _each(k, n), _ends(variables, _each(bs, n), knots))


def re(variable: str) -> Term:
    """Random effect of a category."""
    return Term("re", (variable,), ("re",), (0,), (None,))


def linear(variable: str) -> Term:
    return Term("linear", (variable,), ("line",), (1,), (None,))


# --- from term to design -----------------------------------------------------------------------


def covariate_points(frame: DataFrame, wanted: Sequence[tuple[str, str, int, tuple | None]]) -> list[np.ndarray]:
    """For each (column, basis, k, ends) points of the covariate's distinct values, evenly spaced in rank: k knots of a
    cubic basis, up to CENTRES centres of a thin plate one. End knots are among the values first, and values beyond them are left out. One
    search for ranks serves all covariates, whatever the number of their values."""
    if not wanted:
        return []
    spark = frame.sparkSession
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, (c, *_) in enumerate(wanted)])
    values = frame.select(F.explode(listed).alias("p")).select("p.*")
    ends = [(i, float(e)) for i, (*_, given) in enumerate(wanted) for e in given or ()]
    if ends:
        within = F.lit(True)
        for i, (*_, given) in enumerate(wanted):
            if given:
                within &= (F.col("i") != i) | F.col("x").between(float(given[0]), float(given[1]))
        values = values.where(within).unionByName(spark.createDataFrame(ends, "i int, x double"))
    n = F.col("n")
    count = F.lit(0)
    for i, (_, bs, k, _) in enumerate(wanted):
        count = F.when(F.col("i") == i, F.least(n, F.lit(CENTRES)) if bs == "tp" else F.lit(k)).otherwise(count)
    found = order_statistics(values.distinct(), "x", evenly_ranked(count.cast("long")), ["i"])
    ranked: list[dict] = [{} for _ in wanted]
    for r in found.collect():
        ranked[r.i][r.t.i, r.t.side] = (r.x, r.t.part, r.t.n)
    out = []
    for (c, bs, k, _), own in zip(wanted, ranked):
        size = next(iter(own.values()))[2] if own else 0
        if size < k:
            raise ValueError(f"{c}: {size} distinct values, {k} {'are needed' if bs == 'tp' else 'knots wanted'}")
        points = [(own[i, 0][0], own[i, 1][0], own[i, 0][1]) for i in range(len(own) // 2)]
        out.append(np.array([a if a == b else (1 - h) * a + h * b for a, b, h in points]))
    return out


def _levels(frame: DataFrame, column: str) -> list:
    return sorted(r[0] for r in frame.select(F.col(column).cast("string").alias("v")).distinct().collect())


def marginals(frame: DataFrame, wanted: Sequence[tuple[str, str, int, tuple | None]]) -> dict:
    """The basis of each (column, basis, k, ends)."""
    wanted = list(dict.fromkeys(wanted))
    pointed = [w for w in wanted if w[1] in ("tp", "cr", "cc")]
    points = dict(zip(pointed, covariate_points(frame, pointed)))
    made = {
        "re": lambda w: LevelBasis(_levels(frame, w[0])),
        "line": lambda w: LineBasis(),
        "tp": lambda w: ThinPlateBasis(points[w], w[2]),
        "cr": lambda w: CubicBasis(points[w]),
        "cc": lambda w: CubicBasis(points[w], cyclic=True),
    }
    for _, bs, *_ in wanted:
        if bs not in made:
            raise ValueError(f"unknown basis {bs!r}")
    return {w: made[w[1]](w) for w in wanted}


@dataclass
class Smooth:
    """A term bound to its bases: maps covariate arrays to centred design columns."""

    term: Term
    columns: list[int]  # positions of its covariates in the frame
    bases: list
    margin_map: list = field(default_factory=list)  # per margin: contrast matrix or None
    contrast: np.ndarray | None = None
    penalties: list = field(default_factory=list)
    start: int = 0

    @property
    def label(self) -> str:
        return self.term.label

    @property
    def raw_size(self) -> int:
        sizes = [m.shape[1] if m is not None else b.size for b, m in zip(self.bases, self.margin_map)]
        return int(np.prod(sizes))

    @property
    def size(self) -> int:
        return self.raw_size if self.contrast is None else self.contrast.shape[1]

    @property
    def block(self) -> slice:
        return slice(self.start, self.start + self.size)

    def margins(self, values: Sequence) -> list[np.ndarray]:
        """Basis rows of each covariate, evaluated once per value of a batch and looked up for its rows."""
        out = []
        for b, c in zip(self.bases, self.columns):
            own, place = np.unique(values[c], return_inverse=True) if b.lookup else (values[c], None)
            out.append(b.design(own) if place is None else b.design(own)[place])
        return out

    def raw(self, values: Sequence) -> np.ndarray:
        out = None
        for x, contrast in zip(self.margins(values), self.margin_map):
            x = x if contrast is None else x @ contrast
            out = x if out is None else (out[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return out

    def design(self, values: Sequence) -> np.ndarray:
        x = self.raw(values)
        return x if self.contrast is None else x @ self.contrast


def contrast_to(means: np.ndarray) -> np.ndarray:
    """Columns spanning the coefficients whose combination with `means` is 0."""
    q, _ = np.linalg.qr(means[:, None], mode="complete")
    return q[:, 1:]


def tensor_penalties(bases, margin_map) -> list[np.ndarray]:
    sizes, scaled = [], []
    for b, m in zip(bases, margin_map):
        p = b.penalty if m is None else m.T @ b.penalty @ m
        scaled.append(p / max(np.linalg.norm(p, 2), 1e-300))
        sizes.append(p.shape[0])
    out = []
    for i in range(len(bases)):
        parts = [scaled[j] if j == i else np.eye(sizes[j]) for j in range(len(bases))]
        total = parts[0]
        for p in parts[1:]:
            total = np.kron(total, p)
        out.append(total)
    return out


def null_space_penalty(penalties: list[np.ndarray]) -> np.ndarray | None:
    """Projection on what the penalties leave free, so a whole term can shrink to zero."""
    total = sum(p / np.linalg.norm(p) for p in penalties)
    values, vectors = np.linalg.eigh(total)
    free = vectors[:, values < values.max() * 1e-10]
    return free @ free.T if free.shape[1] else None


@dataclass
class Design:
    """Intercept and smooths. Executors call `matrix` on batches of covariates."""

    smooths: list[Smooth]
    variables: list[str]
    level: LevelTerm | None = None  # the random effect that is kept as a table

    @property
    def size(self) -> int:
        return 1 + sum(sm.size for sm in self.smooths)

    def place(self):
        at = 1
        for sm in self.smooths:
            sm.start, at = at, at + sm.size
        return self

    def matrix(self, values: Sequence) -> np.ndarray:
        n = len(values[0]) if len(values) else 0
        return np.column_stack([np.ones(n), *[sm.design(values) for sm in self.smooths]])

    @property
    def labels(self) -> list[str]:
        return [sm.label for sm in self.smooths] + ([self.level.label] if self.level else [])

    def term(self, label: str) -> Smooth | LevelTerm:
        for sm in [*self.smooths, *([self.level] if self.level else [])]:
            if sm.label == label:
                return sm
        raise ValueError(f"no term {label!r}; terms are {self.labels}")

    def without(self, labels: Sequence[str]) -> Design:
        import copy

        for label in labels:
            self.term(label)
        kept = [copy.copy(sm) for sm in self.smooths if sm.label not in labels]
        level = self.level if self.level and self.level.label not in labels else None
        return Design(kept, self.variables, level).place()
