"""Exact null distributions of rank statistics without ties, for small samples.

Everything counts arrangements by adding positive numbers, so relative errors stay near rounding. Distributions are kept by sample size, because
grouped tests ask for the same few sizes again and again.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from statloom.functions import special as sp

#: Rank tests are exact below so many values in each sample; the two-sample distance below so many cells, the one-sample distance below so many values.
SMALL, CELLS, SAMPLE = 50, 10_000, 100


def _chosen(scores: np.ndarray, m: int) -> np.ndarray:
    """P(sum = s) of ``m`` of the scores (positive integers) drawn without replacement."""
    top = int(np.sort(scores)[len(scores) - m :].sum())
    ways = np.zeros((m + 1, top + 1))
    ways[0, 0] = 1
    for x in scores.tolist():  # the right side is read whole before it is written
        ways[1:, x:] = ways[1:, x:] + ways[:-1, : top + 1 - x]
    return ways[m] / ways[m].sum()


@functools.lru_cache(maxsize=512)
def rank_sums(m: int, n: int) -> np.ndarray:
    """P(W = w) of the rank sum statistic W of m values among m + n, W from 0 to m n."""
    return _chosen(np.arange(1, m + n + 1), m)[m * (m + 1) // 2 :]


@functools.lru_cache(maxsize=512)
def signed_ranks(n: int) -> np.ndarray:
    """P(V = v) of the signed rank statistic of n values."""
    share = np.zeros(n * (n + 1) // 2 + 1)
    share[0] = 1
    for k in range(1, n + 1):
        share[k:] = share[k:] + share[:-k]
    return share / share.sum()


@functools.lru_cache(maxsize=512)
def ansari(m: int, n: int) -> np.ndarray:
    """P(AB = s) of the Ansari-Bradley statistic of m values among m + n."""
    i = np.arange(1, m + n + 1)
    return _chosen(np.minimum(i, m + n + 1 - i), m)


def two_sided(share: np.ndarray, value: float) -> float:
    """Twice the smaller tail at ``value`` of a distribution over 0, 1, ..., at most 1."""
    k = int(round(value))
    if not 0 <= k < len(share):
        return 0.0
    return float(min(1.0, 2 * min(share[: k + 1].sum(), share[k:].sum())))


def distance_two_sample(d: float, m: int, n: int) -> float:
    """P(D >= d) of the largest distance of two empirical distribution functions: one less the share of lattice paths that stay nearer."""
    bound = (0.5 + math.floor(d * m * n - 1e-7)) / (m * n)
    j = np.arange(n + 1)
    ways, scale = np.zeros(n + 1), 0.0
    ways[0] = 1.0
    for i in range(m + 1):
        near = np.abs(i / m - j / n) < bound
        ways = np.where(near, ways, 0.0)
        if near.any():  # those j are consecutive, so a path comes along the row only from one of them
            ways = np.where(near, np.cumsum(ways), 0.0)
        top = ways.max()
        if top == 0:
            return 1.0
        ways, scale = ways / top, scale + math.log(top)
    if ways[n] == 0:
        return 1.0
    return float(np.clip(-np.expm1(math.log(ways[n]) + scale - float(sp.log_choose(m + n, m))), 0, 1))


def distance_one_sample(d: float, n: int) -> float:
    """P(D >= d) of the distance of an empirical distribution function from a continuous one, by the power of a matrix (Marsaglia, Tsang and Wang, 2003)."""
    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    k = int(n * d) + 1
    size, h = 2 * k - 1, k - n * d
    i, j = np.indices((size, size))
    step = (i - j + 1 >= 0).astype(float)
    edge = h ** np.arange(1, size + 1)
    step[:, 0] -= edge
    step[-1, :] -= edge[::-1]
    if 2 * h > 1:
        step[-1, 0] += (2 * h - 1) ** size
    factor = np.exp(sp.lgamma(np.maximum(i - j + 1, 0) + 1.0))
    step /= factor
    power, scale, square, square_scale, left = np.eye(size), 0.0, step, 0.0, n
    while left:
        if left & 1:
            power, scale = power @ square, scale + square_scale
            top = np.abs(power).max()
            power, scale = power / top, scale + math.log(top)
        square, square_scale = square @ square, 2 * square_scale
        top = np.abs(square).max()
        square, square_scale = square / top, square_scale + math.log(top)
        left >>= 1
    inside = power[k - 1, k - 1]
    if inside <= 0:
        return 1.0
    return float(np.clip(-np.expm1(math.log(inside) + scale + float(sp.lgamma(n + 1.0)) - n * math.log(n)), 0, 1))


def poisson_two_sided(x: int, mu: float) -> float:
    """Sum of the Poisson outcomes that are no likelier than ``x``; the far one is found by bisection, since the mass falls away from ``mu``."""
    if mu == 0:
        return float(x == 0)
    if x == mu:
        return 1.0
    mass = lambda k: k * math.log(mu) - mu - math.lgamma(k + 1)
    bound = mass(x) + 1e-7
    above = lambda k: 1.0 - float(sp.poisson_cdf(k - 1, mu)) if k else 1.0
    if x < mu:
        low, high = math.ceil(mu), math.ceil(mu) + 1
        while mass(high) > bound:
            high *= 2
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if mass(mid) <= bound else (mid + 1, high)
        return min(1.0, float(sp.poisson_cdf(x, mu)) + above(low))
    low, high = -1, math.floor(mu)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mass(mid) <= bound else (low, mid - 1)
    return min(1.0, above(x) + (float(sp.poisson_cdf(low, mu)) if low >= 0 else 0.0))
