"""Binomial probabilities and quantiles over arrays, exact to rounding for any number of draws."""

from __future__ import annotations

import math

import numpy as np

#: Draws up to which a quantile is searched from 0, and from which rarer outcomes on a probability is an integral.
SMALL, MANY = 64, 32
STIRLING = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)])


def stirling_error(n: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks in log n!."""
    small = STIRLING[np.minimum(n, 15).astype(np.int64)]
    x = np.maximum(n, 15.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x**2) / x**2) / x**2) / x
    return np.where(n < 16, small, series)


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, also where x is near the mean."""
    step = (x - mean) / (x + mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / mean), 0.0) + mean - x
    term, total = 2 * x * step, (x - mean) * step
    for k in range(3, 24, 2):
        term = term * step * step
        total = total + term / k
    return np.where(np.abs(step) < 0.1, total, plain)


def binomial_pmf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of k of n, 0 < p < 1, by the saddle-point form."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inner = (k > 0) & (k < n)
    a, b = np.where(inner, k, 1.0), np.where(inner, n - k, 1.0)
    whole = np.where(inner, n, 2.0)
    exponent = stirling_error(whole) - stirling_error(a) - stirling_error(b) - deviance(a, whole * p) - deviance(b, whole * (1 - p))
    middle = np.exp(exponent) * np.sqrt(whole / (2 * np.pi * a * b))
    ends = np.where(k == 0, np.exp(n * np.log1p(-p)), np.where(k == n, np.exp(n * np.log(p)), 0.0))
    return np.where(inner, middle, ends)


def fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for x below about a / (a + b)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of at most k of n, 0 < p < 1, 0 <= k."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inside = k < n
    top = np.where(inside, k, n - 1)
    out = np.ones(k.shape)
    many = inside & (np.minimum(top, n - top) > MANY)
    out[many] = by_quadrature(k[many], n[many], p[many])
    few = inside & ~many
    out[few] = by_fraction(k[few], n[few], p[few])
    return out


def by_fraction(top: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    lower = top + 1 >= (n + 2) * p  # the tail above is the small one
    above = binomial_pmf(top + 1, n, p) * (1 - p) * fraction(top + 1, n - top, p)
    below = binomial_pmf(top, n, p) * p * fraction(n - top, top + 1, 1 - p)
    return np.where(lower, 1 - above, below)


def by_quadrature(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """At most k of n as the part of a beta density above p, by Gauss-Legendre points over at most ten deviations."""
    a, b = k + 1, n - k
    mean = a / (a + b)
    spread = np.sqrt(a * b / (a + b + 1)) / (a + b)
    above = p > mean
    end = np.where(above, np.minimum(1.0, np.maximum(mean + 10 * spread, p + 5 * spread)), np.maximum(0.0, np.minimum(mean - 10 * spread, p - 5 * spread)))
    points, weights = np.polynomial.legendre.leggauss(60)
    total = np.zeros(len(k))
    for x, w in zip((points + 1) / 2, weights / 2):
        off = p + (end - p) * x - mean
        with np.errstate(divide="ignore"):
            total += w * np.exp((a - 1) * np.log1p(off / mean) + (b - 1) * np.log1p(-off / (1 - mean)))
    part = total * np.abs(end - p) * (n + 0.0) * binomial_pmf(a - 1, n - 1, mean)
    return np.where(above, part, 1 - part)


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Good to about three digits; a start for a search."""
    tail = np.sqrt(-2 * np.log(np.clip(np.minimum(u, 1 - u), 1e-300, 0.5)))
    top = 2.515517 + tail * (0.802853 + tail * 0.010328)
    z = tail - top / (1 + tail * (1.432788 + tail * (0.189269 + tail * 0.001308)))
    return np.where(u < 0.5, -z, z)


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The smallest k with at least probability u of k or fewer of n."""
    u, n, p = np.broadcast_arrays(np.asarray(u, float), np.asarray(n, np.int64), np.asarray(p, float))
    out = np.where(p >= 1, n, 0)
    chosen = np.nonzero((n > 0) & (p > 0) & (p < 1))
    u, n, p = u[chosen], n[chosen], p[chosen]
    turned = p > 0.5  # count the rarer side
    p, v = np.where(turned, 1 - p, p), np.where(turned, 1 - u, u)
    k = np.zeros(len(n), np.int64)
    for part, search in ((np.flatnonzero(n <= SMALL), _from_zero), (np.flatnonzero(n > SMALL), _from_guess)):
        if len(part):
            k[part] = search(v[part], n[part], p[part])
    out[chosen] = np.where(turned, n - k, k)
    return out


def _from_zero(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    odds, pmf = p / (1 - p), (1 - p) ** n
    cdf, k, at = pmf.copy(), np.zeros(len(n), np.int64), np.arange(len(n))
    at = at[cdf < u]
    while len(at):
        pmf[at] *= (n[at] - k[at]) / (k[at] + 1) * odds[at]
        k[at] += 1
        cdf[at] += pmf[at]
        at = at[(cdf[at] < u[at]) & (k[at] < n[at])]
    return k


def _from_guess(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    z, spread = normal_quantile(u), np.sqrt(n * p * (1 - p))
    k = np.clip(np.floor(n * p + spread * z + (1 - 2 * p) * (z * z - 1) / 6), 0, n).astype(np.int64)
    cdf, pmf, odds = binomial_cdf(k, n, p), binomial_pmf(k, n, p), p / (1 - p)
    at = np.flatnonzero((cdf < u) & (k < n))
    while len(at):
        pmf[at] *= (n[at] - k[at]) / (k[at] + 1) * odds[at]
        k[at] += 1
        cdf[at] += pmf[at]
        at = at[(cdf[at] < u[at]) & (k[at] < n[at])]
    at = np.flatnonzero((cdf - pmf >= u) & (k > 0))
    while len(at):
        cdf[at] -= pmf[at]
        pmf[at] *= k[at] / (n[at] - k[at] + 1) / odds[at]
        k[at] -= 1
        at = at[(cdf[at] - pmf[at] >= u[at]) & (k[at] > 0)]
    return k
