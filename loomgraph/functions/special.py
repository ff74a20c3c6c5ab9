"""Distribution functions, numerically, for significance tests over small result tables."""

from __future__ import annotations

import math


def chi_square_tail(x: float, freedom: float) -> float:
    """P(X > x) by the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = freedom / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    # continued fraction, from below
    value = 0.0
    for k in range(200, 0, -1):
        value = k * (k - a) / (z + 2 * k + 1 - a - value)
    return scale / (z + 1 - a - value)


def student_two_sided(t: float, freedom: float) -> float:
    """P(|T| > |t|) by integrating the density over the angle atan(t / sqrt(freedom))."""
    angle = math.atan2(abs(t), math.sqrt(freedom))
    n = 4000
    f = lambda x: max(math.cos(x), 0.0) ** (freedom - 1)
    step = angle / n
    area = step / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * step) for i in range(n + 1)) if angle else 0.0
    constant = 2 * math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(math.pi)
    return max(0.0, min(1.0, 1 - constant * area))
