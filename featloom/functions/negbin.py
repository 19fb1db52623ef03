"""Distributions whose parameters are Columns: one distribution per table row.

Densities and parameter algebra are Column expressions. Only the cumulative
distribution function needs Python, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import log_choose, negbin_cdf

ALTERNATIVES = (None, "two-sided", "less", "greater")


def _double(value) -> Column | None:
    if value is None:
        return None
    column = F.col(value) if isinstance(value, str) else value
    return (column if isinstance(column, Column) else F.lit(column)).cast("double")


def _evaluate_cdf(x: pd.Series, mean: pd.Series, r: pd.Series) -> pd.DataFrame:
    # Counts repeat: each distinct input of the batch is evaluated once.
    inputs = np.column_stack([s.to_numpy("float64") for s in (x, mean, r)])
    distinct, of = np.unique(inputs.view("u8").reshape(-1, 3), axis=0, return_inverse=True)
    cdf, log_cdf = negbin_cdf(*np.ascontiguousarray(distinct).view("f8").reshape(-1, 3).T)
    of = of.reshape(-1)
    return pd.DataFrame({"cdf": cdf[of], "log_cdf": log_cdf[of]})


def _cdf_pair(x: Column, mean: Column, r: Column) -> Column:
    """Struct ``cdf, log_cdf``, computed together in Arrow batches; NaN where undefined."""
    return F.pandas_udf(_evaluate_cdf, "cdf double, log_cdf double")(x, mean, r)


def _nan_as_null(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))


class NegativeBinomial:
    """Negative binomial with parameters given as Columns, column names or numbers.

    Give one of shape ``r`` and ``variance``, and one of ``p`` and ``mean``. Where the
    variance does not exceed the mean there is no such distribution: ``r``, and all
    that is computed from it, is null.
    """

    def __init__(self, r=None, variance=None, p=None, mean=None):
        if (r is None) == (variance is None):
            raise ValueError("give exactly one of shape 'r' and 'variance'")
        if (p is None) == (mean is None):
            raise ValueError("give exactly one of 'p' and 'mean'")
        r, variance, p, mean = (_double(v) for v in (r, variance, p, mean))
        if mean is None:
            mean = F.try_divide(p * r, 1.0 - p) if variance is None else variance * (1.0 - p)
        self.mean = mean
        self.overdispersed = F.lit(True) if variance is None else variance > mean
        self.r = r if variance is None else F.when(
            variance > mean, F.try_divide(mean * mean, variance - mean))

    @classmethod
    def mme(cls, value) -> "NegativeBinomial":
        """Method-of-moments fit as aggregate Columns, for use in ``groupBy(...).agg(...)``."""
        data = _double(value)
        return cls(mean=F.avg(data), variance=F.var_pop(data))

    @property
    def variance(self) -> Column:
        return self.mean + F.try_divide(self.mean * self.mean, self.r)

    @property
    def p(self) -> Column:
        return F.try_divide(self.mean, self.r + self.mean)

    @property
    def log_p(self) -> Column:
        return F.log(self.mean) - F.log(self.r + self.mean)

    @property
    def log_1p(self) -> Column:
        """Logarithm of ``1 - p``."""
        return F.log(self.r) - F.log(self.r + self.mean)

    def log_prob(self, x) -> Column:
        """Logarithm of the probability of ``x``; minus infinity for ``x <= -1``."""
        x = _double(x)
        # log1p(m / r), not log_1p: exact to the last digits for a huge r
        value = (log_choose(self.r, x) - self.r * F.log1p(self.mean / self.r)
                 + x * F.log(self.mean / (self.r + self.mean)))
        return F.when((self.r > 0) & (x > -1.0), value).when(
            (self.r > 0) & (self.mean > 0), F.lit(float("-inf")))

    def prob(self, x) -> Column:
        return F.exp(self.log_prob(x))

    def cdf_pair(self, x) -> Column:
        """CDF and its logarithm as one struct ``cdf, log_cdf``; NaN where undefined."""
        return _cdf_pair(_double(x), self.mean, self.r)

    def cdf(self, x) -> Column:
        """Probability of at most ``floor(x)``."""
        return _nan_as_null(self.cdf_pair(x)["cdf"])

    def log_cdf(self, x) -> Column:
        return _nan_as_null(self.cdf_pair(x)["log_cdf"])

    def pval(self, x, alternative: str | None = None) -> Column:
        """p-value of ``x``; two-sided unless ``alternative`` is ``"less"`` or ``"greater"``."""
        return tail_pvalue(self.cdf(x), self.prob(x), alternative)


def tail_pvalue(cdf: Column, density: Column, alternative: str | None) -> Column:
    """p-value from a CDF and a density at the same point."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative is one of {ALTERNATIVES}, not {alternative!r}")
    if alternative == "less":
        return cdf
    greater = 1.0 - cdf + density
    if alternative == "greater":
        return greater
    # least() skips nulls, but an undefined distribution has no p-value. The condition
    # names the CDF only: the density is a long expression, and would be generated twice.
    return F.when(cdf.isNotNull(), 2.0 * F.least(F.lit(0.5), cdf, greater))


class Normal:
    """Normal distribution with Column parameters."""

    def __init__(self, mean, sd):
        self.mean, self.sd = _double(mean), _double(sd)


class Beta:
    """Beta distribution given by its mean and sample size."""

    def __init__(self, mean, samplesize):
        mean, samplesize = _double(mean), _double(samplesize)
        self.p = mean * samplesize
        self.q = (1.0 - mean) * samplesize
