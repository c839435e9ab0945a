"""One-dimensional bases: numpy helpers evaluated inside tasks, built from a few knots.

Cubic bases are parameterised by the value of the curve at its knots; their penalty is the
integrated squared second derivative (Wood, Generalized Additive Models, 2017, section 5.3).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass
class CubicBasis:
    """Natural cubic spline on the knots, or a cyclic one whose last knot is its first."""

    knots: np.ndarray
    cyclic: bool = False
    lookup = True  # worth evaluating once per value of a batch

    def __post_init__(self):
        k = self.knots = np.asarray(self.knots, dtype=float)
        h = np.diff(k)
        if (h <= 0).any():
            raise ValueError(f"knots must increase: {k}")
        m = len(h) if self.cyclic else len(k)
        band, second = np.zeros((m, m)), np.zeros((m, m))
        for i in range(m) if self.cyclic else range(1, m - 1):
            left, right = h[i - 1], h[i]
            prev, following = (i - 1) % m, (i + 1) % m
            band[i, i] += (left + right) / 3
            band[i, prev] += left / 6
            band[i, following] += right / 6
            second[i, prev] += 1 / left
            second[i, following] += 1 / right
            second[i, i] -= 1 / left + 1 / right
        inner = slice(0, m) if self.cyclic else slice(1, m - 1)
        solved = np.linalg.solve(band[inner, inner], second[inner])
        self.curvature = np.zeros((m, m))  # second derivative at each knot, per coefficient
        self.curvature[inner] = solved
        self.penalty = second[inner].T @ solved
        self.size = m

    def design(self, x: np.ndarray) -> np.ndarray:
        k, m = self.knots, self.size
        x = np.asarray(x, dtype=float)
        if self.cyclic:
            x = k[0] + np.mod(x - k[0], k[-1] - k[0])
        at = np.clip(x, k[0], k[-1])
        j = np.clip(np.searchsorted(k, at, side="right") - 1, 0, len(k) - 2)
        h = k[j + 1] - k[j]
        right, left = k[j + 1] - at, at - k[j]
        rows = np.arange(len(x))
        following = (j + 1) % m
        out = np.zeros((len(x), m))
        out[rows, j] += right / h
        out[rows, following] += left / h
        out += ((right**3 / h - h * right) / 6)[:, None] * self.curvature[j]
        out += ((left**3 / h - h * left) / 6)[:, None] * self.curvature[following]
        beyond = x - at  # straight lines outside the knots
        if not self.cyclic and beyond.any():
            far = np.flatnonzero(beyond)
            out[far] += beyond[far, None] * self._end_slope()[(beyond[far] > 0).astype(int)]
        return out

    def _end_slope(self) -> np.ndarray:
        k, f, m = self.knots, self.curvature, self.size
        first, last = np.zeros(m), np.zeros(m)
        h0, h1 = k[1] - k[0], k[-1] - k[-2]
        first[0], first[1] = -1 / h0, 1 / h0
        last[-2], last[-1] = -1 / h1, 1 / h1
        return np.vstack([first - f[1] * h0 / 6, last + f[-2] * h1 / 6])


@dataclass
class ThinPlateBasis:
    """Low-rank thin plate spline of one variable: the leading eigenvectors of |x - x'|^3 / 12 over
    a set of centres, plus constant and line (Wood, 2003)."""

    centres: np.ndarray
    k: int
    lookup = True

    def __post_init__(self):
        c = np.asarray(self.centres, dtype=float)
        if len(c) < self.k:
            raise ValueError(f"{len(c)} distinct values are too few for a basis of {self.k}")
        self.origin, self.span = c.min(), c.max() - c.min()
        u = self.centres = (c - self.origin) / self.span
        values, vectors = np.linalg.eigh(self._radial(u))
        lead = np.argsort(-np.abs(values))[: self.k]
        values, vectors = values[lead], vectors[:, lead]
        polynomial = np.column_stack([np.ones_like(u), u])
        q, _ = np.linalg.qr(vectors.T @ polynomial, mode="complete")
        free = q[:, 2:]
        self.weights = vectors @ free
        self.size = self.k
        self.penalty = np.zeros((self.k, self.k))
        self.penalty[: self.k - 2, : self.k - 2] = free.T @ (values[:, None] * free)
        # columns of comparable size
        scale = np.sqrt(np.mean((self._radial(u) @ self.weights) ** 2, axis=0))
        self.weights = self.weights / scale
        self.penalty[: self.k - 2, : self.k - 2] /= np.outer(scale, scale)

    def _radial(self, u):
        return np.abs(u[:, None] - self.centres[None, :]) ** 3 / 12

    def design(self, x: np.ndarray) -> np.ndarray:
        u = (np.asarray(x, dtype=float) - self.origin) / self.span
        return np.column_stack([self._radial(u) @ self.weights, np.ones_like(u), u])


@dataclass
class LevelBasis:
    """One column per category; a category not seen in the fit gets zeros."""

    levels: list
    lookup = False

    def __post_init__(self):
        self.size = len(self.levels)
        self.penalty = np.eye(self.size)

    def design(self, x) -> np.ndarray:
        codes = pd.Categorical(x, categories=self.levels).codes
        out = np.zeros((len(codes), self.size))
        known = np.flatnonzero(codes >= 0)
        out[known, codes[known]] = 1.0
        return out


@dataclass
class LineBasis:
    """The variable itself."""

    lookup = False

    def __post_init__(self):
        self.size, self.penalty = 1, np.zeros((1, 1))

    def design(self, x) -> np.ndarray:
        return np.asarray(x, dtype=float)[:, None]
