"""Driver-side scalar statistics on 1-row aggregate results.

Spark computes the sufficient statistics (r, n, rank sums, tie terms); the
p-values are then a handful of floating-point operations on one row.
No scipy: the Student-t tail uses the regularised incomplete beta function
(continued fraction), the normal tail ``math.erfc``.
"""

from __future__ import annotations

import math


def _betacf(a: float, b: float, x: float, max_iter: int = 500, eps: float = 3e-16) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def pearson_t(r: float, n: int) -> float:
    """t statistic of a Pearson r on n pairs."""
    if n < 3 or r is None:
        return float("nan")
    if abs(r) >= 1.0:
        return math.copysign(float("inf"), r)
    return r * math.sqrt((n - 2) / (1.0 - r * r))


def pearson_p_value(r: float, n: int) -> float:
    """Two-sided p-value of H0: rho = 0 (Student t with n-2 dof)."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t = pearson_t(r, n)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def mann_whitney_p_value(u1: float, n1: int, n2: int, tie_term: float, continuity: bool = True) -> tuple[float, float]:
    """Two-sided normal approximation with tie correction: returns (z, p).

    ``tie_term`` = sum over distinct values of t**3 - t for the pooled sample.
    Matches scipy's ``mannwhitneyu(..., alternative="two-sided")`` asymptotic
    method: U = max(U1, U2) against mu, continuity 0.5.
    """
    n = n1 + n2
    mu = n1 * n2 / 2.0
    u2 = n1 * n2 - u1
    u = max(u1, u2)
    var = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if var <= 0:
        return float("nan"), 1.0
    z = (u - mu - (0.5 if continuity else 0.0)) / math.sqrt(var)
    p = math.erfc(z / math.sqrt(2.0))
    return z, min(1.0, max(0.0, p))
