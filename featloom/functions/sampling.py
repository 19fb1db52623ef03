"""Random variables for whole arrays, each element from a seed of its own.

An element's variable depends on its seed alone, not on its neighbours. Rejection methods run in rounds over the
elements that have no value yet; a round draws from the next numbers of each element's stream.
"""

from __future__ import annotations

import numpy as np

from .special import log_gamma


def _hashed(seeds: np.ndarray, number: int) -> np.ndarray:
    x = seeds + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stream:
    """Hashed uniforms by seed and position; every call takes the next position.

    A rejection method takes its numbers from a stream of its own: how many rounds other elements need must not
    move an element's later numbers.
    """

    def __init__(self, seeds: np.ndarray):
        self.seeds, self.position = seeds.astype(np.uint64), 0

    def own(self) -> Stream:
        self.position += 1
        return Stream(_hashed(self.seeds, -self.position))

    def uniform(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Uniforms in (0, 1) for the chosen elements."""
        self.position += 1
        x = _hashed(self.seeds[of], self.position)
        return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52

    def normal(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.sqrt(-2.0 * np.log(self.uniform(of))) * np.cos(2.0 * np.pi * self.uniform(of))

    def gamma(self, shape: np.ndarray) -> np.ndarray:
        """Gamma variables of scale 1, by squeezing cubes of normal ones; a shape below 1 is raised by a power."""
        raised = np.where(shape < 1.0, shape + 1.0, shape)
        d = raised - 1.0 / 3.0
        c = 1.0 / np.sqrt(9.0 * d)
        out, left, tries = np.empty(len(shape)), np.arange(len(shape)), self.own()
        while len(left):
            x, u = tries.normal(left), tries.uniform(left)
            v = (1.0 + c[left] * x) ** 3
            with np.errstate(invalid="ignore", divide="ignore"):
                good = (v > 0) & (np.log(u) < 0.5 * x * x + d[left] * (1.0 - v + np.log(v)))
            out[left[good]] = d[left[good]] * v[good]
            left = left[~good]
        power = self.uniform()
        return np.where(shape < 1.0, out * power ** (1.0 / np.maximum(shape, 1e-300)), out)

    def beta(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, y = self.gamma(p), self.gamma(q)
        return x / (x + y)

    def poisson(self, rate: np.ndarray) -> np.ndarray:
        """Poisson variables: by inversion below a rate of 30, else by rejection from a transformed uniform."""
        out = np.zeros(len(rate))
        small = np.flatnonzero(rate < 30.0)
        u, k = self.uniform(), np.zeros(len(rate))
        term = np.exp(-np.minimum(rate, 700.0))
        total = term.copy()
        left = small[u[small] > total[small]]
        while len(left):
            k[left] += 1
            term[left] *= rate[left] / k[left]
            total[left] += term[left]
            left = left[(u[left] > total[left]) & (term[left] > 1e-300)]
        out[small] = k[small]
        left = np.flatnonzero(rate >= 30.0)
        root = np.sqrt(rate)
        b = 0.931 + 2.53 * root
        a = -0.059 + 0.02483 * b
        inverse = 1.1239 + 1.1328 / (b - 3.4)
        tries = self.own()
        while len(left):
            u, v = tries.uniform(left) - 0.5, tries.uniform(left)
            us = 0.5 - np.abs(u)
            n = np.floor((2.0 * a[left] / us + b[left]) * u + rate[left] + 0.43)
            with np.errstate(invalid="ignore", divide="ignore"):
                density = n * np.log(rate[left]) - rate[left] - log_gamma(np.maximum(n, 0.0) + 1.0)
                good = (n >= 0) & (np.log(v * inverse[left] / (a[left] / (us * us) + b[left])) <= density)
            out[left[good]] = n[good]
            left = left[~good]
        return out
