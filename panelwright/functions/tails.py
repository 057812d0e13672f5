"""Tail probabilities of Student's t and Fisher's F, for degrees of freedom of any size."""

from __future__ import annotations

import math

LARGE = 10_000.0  # degrees of freedom beyond which expansions are nearer than the continued fraction


def _converged(change: float, what: str, left: int) -> bool:
    if abs(change - 1.0) < 1e-15:
        return True
    if not left:
        raise ArithmeticError(f"{what} did not converge")
    return False


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if _converged(c * d, "the incomplete beta function", 9_999 - m):
            break
    return value


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if _converged(1.0 + term / total, "the incomplete gamma function", 9_999 - n):
                break
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for n in range(1, 10_000):
        step = -n * (n - a)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        value *= c * d
        if _converged(c * d, "the incomplete gamma function", 9_999 - n):
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    if df > LARGE:
        return _t_expanded(t, df)
    return beta_regularised(df / 2.0, 0.5, df / (df + t * t))


def _t_expanded(t: float, df: float) -> float:
    """Hill's expansion (1970) of t into a normal deviate; its logarithm keeps the far tails right."""
    a = df - 0.5
    b = 48.0 * a * a
    z2 = a * math.log1p(t * t / df)
    z = math.sqrt(z2)
    first = (z2 + 3.0) * z / b
    second = (((4.0 * z2 + 33.0) * z2 + 240.0) * z2 + 855.0) * z / (10.0 * b * (b + 0.8 * z2 * z2 + 100.0))
    return math.erfc((z + first - second) / math.sqrt(2.0))


def f_upper(f: float, df1: float, df2: float) -> float:
    if df2 > 100.0 * LARGE:
        # Bartlett's correction: this statistic is chi-square to the order of 1 / df2 squared.
        return gamma_upper(df1 / 2.0, (df2 + df1 / 2.0 - 1.0) * math.log1p(df1 * f / df2) / 2.0)
    return beta_regularised(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))
