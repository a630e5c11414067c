"""Scalar tail probabilities, used on report rows (one per column), never on data rows."""

from __future__ import annotations

import math


def kolmogorov_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    if n1 <= 0 or n2 <= 0:
        return 1.0
    lam = d * math.sqrt(n1 * n2 / (n1 + n2))
    if lam < 0.2:
        return 1.0
    total = 0.0
    for j in range(1, 101):
        term = 2.0 * (-1) ** (j - 1) * math.exp(-2.0 * (j * lam) ** 2)
        total += term
        if abs(term) < 1e-16:
            break
    return min(1.0, max(0.0, total))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, Q(df/2, x/2)."""
    if df <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= z / n
            total += term
        return min(1.0, max(0.0, 1.0 - total * front))
    # continued fraction by the Lentz method
    tiny = 1e-300
    b = z + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return min(1.0, max(0.0, front * h))
