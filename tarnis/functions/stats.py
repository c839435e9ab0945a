"""Scalar distribution functions used on coefficient-sized results (no SciPy needed).

Everything follows the textbook series and continued fractions for the incomplete gamma and beta
functions; quantiles come from bisection on those.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def lgamma(x):
    """Vectorised log-gamma: shift the argument above 8, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.maximum(0, np.ceil(8 - x)).astype(int)
    log_product = np.zeros_like(x)
    for step in range(int(shift.max(initial=0))):
        log_product += np.where(step < shift, np.log(np.where(step < shift, x + step, 1.0)), 0.0)
    z = x + shift
    inv = 1 / z
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680 + inv**9 / 1188
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - log_product


def _continued_fraction(first_denominator, coefficients, limit=500, eps=1e-15):
    """Modified Lentz evaluation of 1/(d0 + a1/(d1 + a2/(d2 + ...)))."""
    tiny = 1e-300
    value = c = 1.0
    d = 1.0 / (first_denominator or tiny)
    value = d
    c = 1.0 / tiny
    for _, (a, b) in zip(range(limit), coefficients):
        d = 1.0 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        factor = c * d
        value *= factor
        if abs(factor - 1) < eps:
            break
    return value


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale

    def terms():
        i = 0
        while True:
            i += 1
            yield -i * (i - a), x + 1 - a + 2 * i

    return scale * _continued_fraction(x + 1 - a, terms())


def chi2_tail(x: float, df: float) -> float:
    """P(chi-square with df degrees > x); df may be fractional."""
    return gamma_upper(df / 2, x / 2)


def beta_lower(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def terms():
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return front / a * _continued_fraction(1.0, terms())


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_lower(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return beta_lower(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F with (d1, d2) degrees > f)."""
    return beta_lower(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """Critical value of Student's t; normal above 10,000 degrees of freedom."""
    if df > 1e4:
        return normal_quantile(p)
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2
