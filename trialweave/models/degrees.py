"""Small-sample inference for linear mixed models: degrees of freedom and the tails they need."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .fit import Fit
from .lmm import Deviance

_DELTA = 1e-5


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d)
            c = 1.0 + term / c
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_share(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by bisection on the tail."""
    low, high = 0.0, 1.0
    while t_tail(high, df) / 2.0 > 1.0 - p:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if t_tail(middle, df) / 2.0 > 1.0 - p else (low, middle)
    return (low + high) / 2.0


def range_tail(q: float, k: int, df: float) -> float:
    """P(studentised range of k means > q): the normal range averaged over the scale's distribution."""
    x = np.linspace(-8.0, 8.0, 1601)
    phi = np.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in x])
    wide = np.linspace(-16.0, 16.0, 3201)
    whole = np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in wide])

    def inside(w: float) -> float:
        return float(k * np.trapezoid(phi * (cdf - np.interp(x - w, wide, whole, left=0.0)) ** (k - 1), x))

    sd = 1.0 / math.sqrt(2.0 * df)
    s = np.linspace(max(1e-6, 1.0 - 8.0 * sd), 1.0 + 10.0 * sd, 801)
    logs = (df - 1.0) * np.log(s) - df * s * s / 2.0
    density = np.exp(logs - logs.max())
    density /= np.trapezoid(density, s)
    return float(min(1.0, max(0.0, 1.0 - np.trapezoid(density * np.array([inside(q * v) for v in s]), s))))


def satterthwaite(fit: Fit) -> Callable[[np.ndarray], float]:
    """Degrees of freedom of linear combinations of the fixed effects.

    Twice the squared variance of the combination over the variance of that variance, which
    follows from the curvature of the deviance in the covariance parameters and the residual scale.
    Directions without curvature, as at a variance of zero, are left out.
    """
    if fit.family != "gaussian" or fit.compressed is None:
        raise ValueError("degrees of freedom belong to linear mixed models")
    dev = Deviance(fit.compressed, fit.reml)
    p, k = len(fit.beta), dev.k
    df = fit.compressed.size - (p if fit.reml else 0)
    found = dev.borders([fit.theta] + [fit.theta + _DELTA * e for e in np.eye(k)], True)
    sigma = math.sqrt(fit.sigma2)

    def slopes(a, logs):
        """Gradient of the deviance in the covariance parameters at this residual scale, and that of the residual sum."""
        beta = np.linalg.solve(a[0, :p, :p], a[0, :p, p])
        away = np.append(-beta, 1.0)
        rss = np.einsum("i,dij,j->d", away, a[1:], away)
        out = logs[1:] + rss / fit.sigma2
        if fit.reml:
            out = out + np.array([np.trace(np.linalg.solve(a[0, :p, :p], d[:p, :p])) for d in a[1:]])
        return out, rss, a[0, p, p] - a[0, :p, p] @ beta

    base, change, rss = slopes(*found[0])
    hess = np.zeros((k + 1, k + 1))
    hess[:k, :k] = [(slopes(*f)[0] - base) / _DELTA for f in found[1:]]
    hess[:k, :k] = (hess[:k, :k] + hess[:k, :k].T) / 2.0
    hess[k, :k] = hess[:k, k] = -2.0 * change / sigma**3
    hess[k, k] = -2.0 * df / fit.sigma2 + 6.0 * rss / fit.sigma2**2
    values, vectors = np.linalg.eigh(hess)
    good = values > 1e-8 * max(values.max(), 1.0)
    spread = (vectors[:, good] * (2.0 / values[good])) @ vectors[:, good].T
    inverse = np.linalg.inv(found[0][0][0, :p, :p])
    moved = [-fit.sigma2 * inverse @ d[:p, :p] @ inverse for d in found[0][0][1:]] + [2.0 * sigma * inverse]

    def degrees(row: np.ndarray) -> float:
        slope = np.array([row @ m @ row for m in moved])
        return float(2.0 * (row @ fit.cov @ row) ** 2 / max(slope @ spread @ slope, 1e-300))

    return degrees
