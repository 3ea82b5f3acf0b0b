"""Tail probabilities of the usual test distributions, in plain Python (driver or workers)."""

from __future__ import annotations

import math


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series for the lower part
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300  # continued fraction by Lentz's method
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse normal distribution: bisection on the tail, refined by Newton's method."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_sf(-mid) < p else (lo, mid)
    z = (lo + hi) / 2
    for _ in range(3):
        z -= (normal_sf(-z) - p) / max(math.exp(-z * z / 2) / math.sqrt(2 * math.pi), 1e-300)
    return z


def correlation_p(r: float, n: int) -> float:
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def dagostino_k2(n: int, skew: float, excess: float) -> tuple[float, float]:
    """K2 statistic and p-value from biased skewness and excess kurtosis (n of 8 or more)."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (excess + 3 - e) / math.sqrt(v)
    rb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / rb * (2 / rb + math.sqrt(1 + 4 / rb**2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p-value by Royston's 1995 approximation (AS R94); 3 to 5000 values."""
    x = sorted(values)
    n = len(x)
    if n < 3:
        raise ValueError("at least 3 values are needed")
    mean = math.fsum(x) / n
    ss = math.fsum((v - mean) ** 2 for v in x)
    if ss == 0:
        return 1.0, 1.0
    m = [normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = math.fsum(v * v for v in m)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)
        poly = lambda cs, t: math.fsum(c * t**k for k, c in enumerate(cs))
        # The published polynomials.
        last = poly((m[-1] / math.sqrt(mm), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
        if n > 5:
            before = poly((m[-2] / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = [-last, -before, *[v / math.sqrt(phi) for v in m[2:-2]], before, last]
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *[v / math.sqrt(phi) for v in m[1:-1]], last]
    w = min(1.0, math.fsum(p * q for p, q in zip(a, x)) ** 2 / ss)
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(max(g - math.log(1 - w), 1e-300)) if g > math.log(1 - w) else math.inf
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        t, y = math.log(n), math.log(1 - w)
        mu = -1.5861 - 0.31082 * t - 0.083751 * t**2 + 0.0038915 * t**3
        sigma = math.exp(-0.4803 - 0.082676 * t + 0.0030302 * t**2)
    return w, (0.0 if y == math.inf else normal_sf((y - mu) / sigma))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided p-value of a 2x2 table."""
    row, col, n = a + b, a + c, a + b + c + d
    log_c = lambda p, q: math.lgamma(p + 1) - math.lgamma(q + 1) - math.lgamma(p - q + 1)
    prob = lambda k: math.exp(log_c(row, k) + log_c(n - row, col - k) - log_c(n, col))
    here = prob(a)
    total = math.fsum(p for k in range(max(0, col - (n - row)), min(row, col) + 1) if (p := prob(k)) <= here * (1 + 1e-7))
    odds = math.inf if b * c == 0 and a * d > 0 else math.nan if b * c == 0 else a * d / (b * c)
    return odds, min(1.0, total)


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p-value: exact for small samples without ties, else normal with tie and continuity corrections."""
    if ties == 0 and min(n1, n2) <= 8:
        counts = [1]  # number of ways to reach each U, by adding one value of the second sample at a time
        ways = {(0, 0): [1]}
        for i in range(n1 + 1):
            for j in range(n2 + 1):
                if i == j == 0:
                    continue
                size = i * j + 1
                out = [0] * size
                if i:
                    for k, v in enumerate(ways[i - 1, j]):
                        out[k + j] += v
                if j:
                    for k, v in enumerate(ways[i, j - 1]):
                        out[k] += v
                ways[i, j] = out
        counts = ways[n1, n2]
        top = max(u, n1 * n2 - u)
        return min(1.0, 2 * sum(counts[math.ceil(top) :]) / sum(counts))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n > 1 else 0
    if sd == 0:
        return 1.0
    return min(1.0, 2 * normal_sf((abs(u - n1 * n2 / 2) - 0.5) / sd))
