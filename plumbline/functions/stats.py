"""Interval and quantile formulas on a handful of numbers; nothing here touches a table."""

from __future__ import annotations

import math

Z95 = 1.959964


def wilson(k: float, n: int, z: float = Z95) -> tuple[float, float]:
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def newcombe(k1: int, n1: int, k2: int, n2: int, z: float = Z95) -> tuple[float, float]:
    """Hybrid score interval of the difference of two proportions."""
    a, b = k1 / n1, k2 / n2
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    return a - b - math.hypot(a - l1, u2 - b), a - b + math.hypot(u1 - a, b - l2)


def accuracy_margin(a: float, n_a: int, b: float, n_b: int, z: float = Z95) -> float:
    return z * math.sqrt(a * (1 - a) / n_a + b * (1 - b) / n_b)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t for p over one half, by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - 0.5 * _beta(df / 2, 0.5, df / (df + mid * mid)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def mean_interval(xs: list[float], level: float = 0.95) -> tuple[float, float, float]:
    """Mean and its t interval."""
    n, mean = len(xs), sum(xs) / len(xs)
    if n < 2:
        return mean, mean, mean
    half = t_quantile((1 + level) / 2, n - 1) * math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1) / n)
    return mean, mean - half, mean + half
