"""Probability distributions for driver-side inference: plain floats in, plain floats out.

Only p-values, quantiles and critical values of already aggregated numbers go through
here, so nothing needs to be fast or distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

_STANDARD = NormalDist()
_TINY = 1e-300


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    return _STANDARD.inv_cdf(p)


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), _TINY) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        return _gamma_series(a, x)
    return 1 - _gamma_fraction(a, x)


def gamma_sf(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    return 1 - _gamma_series(a, x) if x < a + 1 else _gamma_fraction(a, x)


def _gamma_series(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def t_sf(t: float, df: float) -> float:
    if math.isinf(df):
        return norm_sf(t)
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return tail if t >= 0 else 1 - tail


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


def two_sided_t(t: float, df: float) -> float:
    if math.isnan(t):
        return math.nan
    return two_sided_normal(t) if math.isinf(df) else beta_cdf(df / (df + t * t), df / 2, 0.5)


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2) if x > 0 else 1.0


def chi2_cdf(x: float, df: float) -> float:
    return 1 - chi2_sf(x, df)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def f_cdf(f: float, d1: float, d2: float) -> float:
    return 1 - f_sf(f, d1, d2)


def find_root(f: Callable[[float], float], low: float, high: float, rounds: int = 200) -> float:
    """Bisection for a monotone function with a sign change."""
    below = f(low) < 0
    for _ in range(rounds):
        mid = (low + high) / 2
        if (f(mid) < 0) == below:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 1.0
    while t_cdf(high, df) < p:
        high *= 2
    return find_root(lambda x: t_cdf(x, df) - p, 0.0, high)


def beta_ppf(p: float, a: float, b: float) -> float:
    return find_root(lambda x: beta_cdf(x, a, b) - p, 0.0, 1.0)


def chi2_ppf(p: float, df: float) -> float:
    high = df + 1
    while chi2_cdf(high, df) < p:
        high *= 2
    return find_root(lambda x: chi2_cdf(x, df) - p, 0.0, high)


def f_ppf(p: float, d1: float, d2: float) -> float:
    high = 2.0
    while f_cdf(high, d1, d2) < p:
        high *= 2
    return find_root(lambda x: f_cdf(x, d1, d2) - p, 0.0, high)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def _integrate(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, panels: int, points: int = 16) -> float:
    node, weight = np.polynomial.legendre.leggauss(points)
    edges = np.linspace(low, high, panels + 1)
    half = np.diff(edges) / 2
    x = (edges[:-1] + half)[:, None] + half[:, None] * node
    return float((f(x) * weight * half[:, None]).sum())


_phi_cdf = np.vectorize(norm_cdf, otypes=[float])


def noncentral_t_cdf(t: float, df: float, nc: float) -> float:
    """P(T <= t) with T = (Z + nc) / sqrt(V / df), by quadrature over V."""

    def f(s: np.ndarray) -> np.ndarray:  # s = sqrt(V / df)
        log = math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
        return np.exp(log) * _phi_cdf(t * s - nc)

    spread = 12 / math.sqrt(2 * df)
    return min(1.0, max(0.0, _integrate(f, max(1e-12, 1 - spread), 1 + spread + (4 if df < 4 else 0), 48)))


def noncentral_f_cdf(f: float, d1: float, d2: float, nc: float) -> float:
    """Poisson mixture of incomplete beta functions."""
    if f <= 0:
        return 0.0
    x, half = d1 * f / (d1 * f + d2), nc / 2
    total, start = 0.0, int(half)
    log = lambda j: -half + (j * math.log(half) if half > 0 else (0.0 if j == 0 else -math.inf)) - math.lgamma(j + 1)
    for direction in (1, -1):
        j = start if direction > 0 else start - 1
        while j >= 0:
            w = math.exp(log(j))
            total += w * beta_cdf(x, d1 / 2 + j, d2 / 2)
            if w < 1e-17:
                break
            j += direction
    return min(1.0, total)


def studentized_range_cdf(q: float, k: float, nu: float) -> float:
    """CDF of the studentised range of k means with nu error degrees of freedom."""
    if q <= 0:
        return 0.0

    def within(r: np.ndarray) -> np.ndarray:
        def f(z: np.ndarray) -> np.ndarray:
            gap = _phi_cdf(z)[None] - _phi_cdf(z[None] - np.reshape(r, (-1, 1, 1)))
            return k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * np.maximum(gap, 0) ** (k - 1)

        node, weight = np.polynomial.legendre.leggauss(16)
        edges = np.linspace(-8, 8, 25)
        half = np.diff(edges) / 2
        z = (edges[:-1] + half)[:, None] + half[:, None] * node
        return (f(z) * weight * half[:, None]).sum((1, 2)).reshape(np.shape(r))

    if nu > 1e5:
        return float(min(1.0, within(np.array([q]))[0]))

    def f(s: np.ndarray) -> np.ndarray:
        log = math.log(2) + (nu / 2) * math.log(nu / 2) - math.lgamma(nu / 2) + (nu - 1) * np.log(s) - nu * s * s / 2
        return np.exp(log) * within((q * s).ravel()).reshape(s.shape)

    spread = 10 / math.sqrt(2 * nu)
    return min(1.0, max(0.0, _integrate(f, max(1e-9, 1 - spread), 1 + spread, 8)))


def studentized_range_p_value(q: float, k: float, nu: float) -> float:
    return 1 - studentized_range_cdf(q, k, nu)


def studentized_range_critical_value(alpha: float, k: float, nu: float) -> float:
    high = 4.0
    while studentized_range_p_value(high, k, nu) > alpha:
        high *= 2
    return find_root(lambda q: alpha - studentized_range_p_value(q, k, nu), 0.0, high, 60)
