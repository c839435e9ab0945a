"""Penalised additive models fitted by Spark jobs over the rows and small solves on the driver."""

from tarnis.smooth.fit import gam
from tarnis.smooth.terms import linear, re, s, te, ti

__all__ = ["gam", "linear", "re", "s", "te", "ti"]
