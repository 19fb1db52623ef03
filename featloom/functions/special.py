"""Log-gamma terms of the negative binomial, and its cumulative distribution.

The formula for the log-gamma terms uses arithmetic plus a natural logarithm only. It
takes the logarithm functions as arguments, so one definition serves Spark Columns (inside
codegen) and numpy arrays (inside Arrow batches). It is kept short on purpose: Java does
not compile a generated method above 8,000 bytes of code, and interpreting one is 20
times slower.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

# Terms B(2k) / (2k (2k-1)) of Stirling's series for ln Gamma.
STIRLING_TERMS = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
# Arguments are moved up by this much before the series is used: error below 1e-15.
SHIFT = 8
_HALF_LOG_TWO_PI = 0.5 * math.log(2 * math.pi)


def _series(z):
    """Stirling's correction at ``z``, Horner form in 1/z^2."""
    inverse_square = 1.0 / (z * z)
    total = STIRLING_TERMS[-1]
    for term in reversed(STIRLING_TERMS[:-1]):
        total = total * inverse_square + term
    return total / z


def _rising(z):
    """z (z+1) ... (z+SHIFT-1)"""
    product = z
    for step in range(1, SHIFT):
        product = product * (z + float(step))
    return product


def log_choose(r, x, log=F.log, log1p=F.log1p):
    """ln Gamma(r + x) - ln Gamma(r) - ln Gamma(x + 1), for r > 0 and x > -1.

    The first two terms are never formed on their own: their difference keeps its digits
    when ``r`` is huge (distributions close to Poisson).
    """
    z, y = r + float(SHIFT), x + float(SHIFT + 1)
    shifted = _rising(x + 1.0) * _rising(r) / _rising(r + x)
    return ((z - 0.5) * log1p(x / z) + x * log(z + x) - x + _series(z + x) - _series(z)
            - (y - 0.5) * log(y) + y - _HALF_LOG_TWO_PI - _series(y) + log(shifted))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0."""
    z = x + float(SHIFT)
    return (z - 0.5) * np.log(z) - z + _HALF_LOG_TWO_PI + _series(z) - np.log(_rising(x))


def negbin_cdf(x: np.ndarray, mean: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(CDF, log CDF) of the negative binomial at ``floor(x)``; NaN where undefined.

    The CDF is the regularised incomplete beta function I_q(r, k + 1) at
    q = r / (r + mean).
    """
    k = np.floor(x)
    cdf = np.full(k.shape, np.nan)
    log_cdf = np.full(k.shape, np.nan)
    defined = (r > 0) & (mean > 0) & np.isfinite(r) & np.isfinite(mean) & ~np.isnan(k)
    cdf[defined & (k < 0)], log_cdf[defined & (k < 0)] = 0.0, -np.inf
    cdf[defined & (k == np.inf)], log_cdf[defined & (k == np.inf)] = 1.0, 0.0

    todo = np.flatnonzero(defined & (k >= 0) & (k < np.inf))
    if todo.size:
        a, b, m = r[todo], k[todo] + 1.0, mean[todo]
        # The continued fraction is fast on the side of the mean where x is small.
        upper = a / (a + m) > (a + 1.0) / (a + b + 2.0)
        first, second = np.where(upper, b, a), np.where(upper, a, b)
        point = np.where(upper, m / (a + m), a / (a + m))
        log_front = np.log(b) - np.log(first) + _log_choose_weighted(a, b, m)
        log_tail = log_front + np.log(_beta_fraction(first, second, point))
        tail = np.minimum(np.exp(log_tail), 1.0)
        cdf[todo] = np.where(upper, 1.0 - tail, tail)
        with np.errstate(divide="ignore"):
            log_cdf[todo] = np.where(upper, np.log1p(-tail), np.minimum(log_tail, 0.0))
    return cdf, log_cdf


def _log_choose_weighted(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``log_choose(a, b)`` + a ln q + b ln p for p = m / (a + m), q = 1 - p, also for huge numbers.

    The saddle-point form: deviances of a and b from their expectations, which are small near the mean, where the plain
    sum would be a small difference of terms as large as the numbers themselves.
    """
    n, p = a + b, m / (a + m)
    plain = np.minimum(a, b) < 20.0
    with np.errstate(invalid="ignore", divide="ignore"):
        # a - n q = -(b - n p) = m (a / m * ... ) without forming n q
        excess = (b * a - a * m) / (a + m)
        deviance = _deviance(a, n * (a / (a + m)), -excess) + _deviance(b, n * p, excess)
        # Gamma(a + b) / (Gamma(a) Gamma(b + 1)) = a b / (n b) * n! / (a! b!) in Stirling's form
        saddle = (_series(n) - _series(a) - _series(b) - deviance
                  + 0.5 * (np.log(a) - np.log(b) - np.log(n)) - _HALF_LOG_TWO_PI)
        direct = -a * np.log1p(m / a) - b * np.log1p(a / m) + log_choose(a, b, np.log, np.log1p)
    return np.where(plain, direct, saddle)


def _deviance(x: np.ndarray, expected: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """x ln(x / expected) - excess, where ``excess`` is x - expected."""
    ratio = excess / (x + expected)
    near = np.abs(ratio) < 0.1
    v = np.where(near, ratio, 0.0)
    # x ln(x / e) = 2 x artanh(v) with v = (x - e) / (x + e); the first term meets the excess
    total, power = excess * v, 2.0 * x * v
    for k in range(1, 12):
        power = power * v * v
        total = total + power / (2 * k + 1)
    return np.where(near, total, x * np.log(x / expected) - excess)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by forward products.

    Each element stops at its own convergence; one that does not converge within
    the bound for its size gives NaN, never a wrong number.
    """
    tiny, precision = 1e-300, 4e-16
    result = np.full(a.shape, np.nan)
    index = np.arange(a.size)
    numerator = np.ones_like(a)
    denominator = 1.0 - (a + b) * x / (a + 1.0)
    denominator = 1.0 / np.where(np.abs(denominator) < tiny, tiny, denominator)
    value = denominator.copy()
    limit = 500 + int(50 * math.sqrt(max(a.max(), b.max())))
    for step in range(1, limit):
        even = step * (b - step) * x / ((a + 2 * step - 1) * (a + 2 * step))
        odd = -(a + step) * (a + b + step) * x / ((a + 2 * step) * (a + 2 * step + 1))
        for term in (even, odd):
            denominator = 1.0 + term * denominator
            denominator = 1.0 / np.where(np.abs(denominator) < tiny, tiny, denominator)
            numerator = 1.0 + term / numerator
            numerator = np.where(np.abs(numerator) < tiny, tiny, numerator)
            change = numerator * denominator
            value = value * change
        done = np.abs(change - 1.0) < precision
        if done.any():
            result[index[done]] = value[done]
            keep = ~done
            if not keep.any():
                break
            index, a, b, x = index[keep], a[keep], b[keep], x[keep]
            numerator, denominator, value = numerator[keep], denominator[keep], value[keep]
    return result
