"""Response families with their usual links.

Sums over the rows of a cell (equal covariates, so equal mean mu) need only the cell's count n, mean
ybar and sum of squared deviations m2; parts of the deviance and likelihood that do not involve mu
are totals over the whole table, computed once by Spark.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tarnis.functions.stats import lgamma


class Family:
    name = ""
    log_link = True
    variance_power: float = 0.0
    positive = False  # zero not allowed
    scale_known = False
    by_row = False  # needs single rows rather than cells
    parameters = 1  # scale

    def total(self, y):
        """Aggregate over all y that the deviance or likelihood needs."""
        return F.sum(F.lit(0.0))

    def start(self, y):
        mu = np.maximum(y, 0.1 * max(float(np.mean(y)), 1e-8)) if self.log_link else y
        return np.log(mu) if self.log_link else mu

    def mean(self, eta):
        return np.exp(np.clip(eta, -700, 700)) if self.log_link else eta

    def variance(self, mu):
        return mu**self.variance_power

    def working(self, eta, y):
        """Fisher weight and working response per row."""
        mu = self.mean(eta)
        if not self.log_link:
            return mu, np.ones_like(mu), y
        return mu, mu ** (2 - self.variance_power), eta + (y - mu) / mu

    def pearson(self, n, ybar, m2, mu):
        return (m2 + n * (ybar - mu) ** 2) / self.variance(mu)

    def deviance(self, n, ybar, m2, mu):
        """Deviance of the cells, without the part that depends on y alone."""
        raise NotImplementedError

    def deviance_constant(self, total: float) -> float:
        return 0.0

    def unit_deviance(self, y, mu):
        """Deviance of single rows, as a column."""
        raise NotImplementedError

    def variance_of(self, mu):
        """Variance function as a column."""
        return F.pow(mu, F.lit(float(self.variance_power)))

    def likelihood_terms(self, n, ybar, mu):
        """Two sums over cells used by `loglik`."""
        return 0.0, 0.0

    def loglik(self, fit) -> float:
        raise NotImplementedError

    def saturated(self, fit) -> float:
        """Log-likelihood with mu = y, at the fitted scale."""
        raise NotImplementedError


class Gaussian(Family):
    name, log_link = "gaussian", False

    def deviance(self, n, ybar, m2, mu):
        return m2 + n * (ybar - mu) ** 2

    def unit_deviance(self, y, mu):
        return (y - mu) * (y - mu)

    def loglik(self, fit):
        return -fit.n / 2 * (math.log(2 * math.pi * fit.deviance / fit.n) + 1)

    def saturated(self, fit):
        return -fit.n / 2 * math.log(2 * math.pi * fit.scale)


class Gamma(Family):
    """Log link. The total is the sum of log y."""

    name, variance_power, positive = "gamma", 2.0, True

    def total(self, y):
        return F.sum(F.ln(y))

    def deviance(self, n, ybar, m2, mu):
        return 2 * n * ((ybar - mu) / mu + np.log(mu))

    def deviance_constant(self, total):
        return -2 * total

    def unit_deviance(self, y, mu):
        return 2 * ((y - mu) / mu - F.ln(y / mu))

    def likelihood_terms(self, n, ybar, mu):
        return float(np.sum(n * ybar / mu)), float(np.sum(n * np.log(mu)))

    def loglik(self, fit):
        a = fit.n / fit.deviance  # shape
        ratio, log_mu = fit.sums
        return (
            (a - 1) * fit.total
            - a * ratio
            - a * log_mu
            + fit.n * (a * math.log(a) - math.lgamma(a))
        )

    def saturated(self, fit):
        a = 1 / fit.scale
        return fit.n * (a * math.log(a) - a - math.lgamma(a)) - fit.total


class InverseGaussian(Family):
    """Log link. The total is the pair (sum of 1/y, sum of log y)."""

    name, variance_power, positive = "inverse_gaussian", 3.0, True

    def total(self, y):
        return F.array(F.sum(1 / y), F.sum(F.ln(y)))

    def deviance(self, n, ybar, m2, mu):
        return n * ybar / mu**2 - 2 * n / mu

    def deviance_constant(self, total):
        return total[0]

    def unit_deviance(self, y, mu):
        return F.try_divide((y - mu) * (y - mu), mu * mu * y)

    def loglik(self, fit):
        scale = fit.deviance / fit.n
        return -0.5 * (fit.n * (math.log(2 * math.pi * scale) + 1) + 3 * fit.total[1])

    def saturated(self, fit):
        return -0.5 * (fit.n * math.log(2 * math.pi * fit.scale) + 3 * fit.total[1])


class Tweedie(Family):
    """Log link, variance mu^power, 1 < power < 2: zeros and positive values together."""

    name, parameters = "tweedie", 2

    def __init__(self, power: float = 1.5):
        if not 1 < power < 2:
            raise ValueError("the power of a Tweedie response lies between 1 and 2")
        self.variance_power = power

    def total(self, y):
        return F.sum(F.pow(y, F.lit(2 - self.variance_power)))

    def deviance(self, n, ybar, m2, mu):
        p = self.variance_power
        return 2 * n * (mu ** (2 - p) / (2 - p) - ybar * mu ** (1 - p) / (1 - p))

    def deviance_constant(self, total):
        p = self.variance_power
        return 2 * total / ((1 - p) * (2 - p))

    def unit_deviance(self, y, mu):
        p = self.variance_power
        own = F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p))
        return 2 * (own - y * F.pow(mu, F.lit(1 - p)) / (1 - p) + F.pow(mu, F.lit(2 - p)) / (2 - p))

    def likelihood_terms(self, n, ybar, mu):
        p = self.variance_power
        return float(np.sum(n * ybar * mu ** (1 - p) / (1 - p) - n * mu ** (2 - p) / (2 - p))), 0.0

    def loglik(self, fit):
        return fit.base_measure(self) + fit.sums[0] / fit.scale

    def saturated(self, fit):
        p = self.variance_power
        return fit.base_measure(self) + fit.total * (1 / (1 - p) - 1 / (2 - p)) / fit.scale

    def log_base(self, y: np.ndarray, scale: float) -> np.ndarray:
        """Log of the density's factor without mu (0 at y = 0): the series of Dunn and Smyth (2005),
        summed over the indices around its largest term; where that index is large the sum is
        replaced by the integral of its Gaussian shape."""
        p = self.variance_power
        alpha = (2 - p) / (1 - p)
        y = np.asarray(y, dtype=float)
        out = np.zeros_like(y)
        pos = y > 0
        if not pos.any():
            return out
        yy = y[pos]
        log_z = (
            -alpha * np.log(yy) + alpha * math.log(p - 1) - (1 - alpha) * math.log(scale) - math.log(2 - p)
        )
        peak = np.maximum(yy ** (2 - p) / (scale * (2 - p)), 1.0)

        def log_term(j, lz):
            return j * lz - lgamma(1 + j) - lgamma(-alpha * j)

        total = np.empty_like(yy)
        large = peak > 2000
        if large.any():
            j, lz = peak[large], log_z[large]
            total[large] = log_term(j, lz) + 0.5 * np.log(2 * np.pi * j / (1 - alpha))
        small = ~large
        if small.any():
            j0, lz = np.round(peak[small]), log_z[small]
            reach = int(np.ceil(np.sqrt(2 * 40 * j0.max() / (1 - alpha)))) + 10
            steps = np.arange(-reach, reach + 1)
            j = j0[:, None] + steps[None, :]
            terms = np.where(j >= 1, log_term(np.maximum(j, 1.0), lz[:, None]), -np.inf)
            top = terms.max(axis=1)
            total[small] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        out[pos] = total - np.log(yy)
        return out


class ScaledT(Family):
    """Identity link; heavy tails through weights that fall with the size of the residual."""

    name, log_link, by_row, parameters = "scaled_t", False, True, 2

    def __init__(self, nu: float = 5.0, sigma: float | None = None):
        self.nu, self.sigma = nu, sigma

    def working(self, eta, y):
        s2 = (self.sigma or 1.0) ** 2
        r2 = (y - eta) ** 2 / s2
        return eta, (self.nu + 1) / (self.nu + r2), y

    def deviance(self, n, ybar, m2, mu):
        s2 = (self.sigma or 1.0) ** 2
        return n * s2 * (self.nu + 1) * np.log1p((ybar - mu) ** 2 / (s2 * self.nu))

    def unit_deviance(self, y, mu):
        s2 = (self.sigma or 1.0) ** 2
        return s2 * (self.nu + 1) * F.log1p((y - mu) * (y - mu) / (s2 * self.nu))

    def pearson(self, n, ybar, m2, mu):
        return n * (ybar - mu) ** 2

    def loglik(self, fit):
        nu, s = self.nu, self.sigma
        constant = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s * s)
        return fit.n * constant - 0.5 * fit.deviance / (s * s)

    def saturated(self, fit):
        nu, s = self.nu, self.sigma
        return fit.n * (
            math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s * s)
        )


FAMILIES = {
    "gaussian": Gaussian,
    "gamma": Gamma,
    "inverse_gaussian": InverseGaussian,
    "tweedie": Tweedie,
    "scaled_t": ScaledT,
}
