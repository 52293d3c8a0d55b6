"""Distribution functions for p-values, from series and continued fractions."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / _away(1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _away(1 + num * d)
            c = _away(1 + num / c)
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _away(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / _away(an * d + b)
        c = _away(b + an / c)
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf2(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def binom_two_sided(k: int, n: int, p: float = 0.5) -> float:
    pmf = [math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(n + 1)]
    return min(1.0, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7)))


def hypergeom_two_sided(a: int, b: int, c: int, d: int) -> float:
    n, row, col = a + b + c + d, a + b, a + c
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    pmf = {k: math.exp(choose(row, k) + choose(n - row, col - k) - choose(n, col)) for k in range(max(0, row + col - n), min(row, col) + 1)}
    return min(1.0, sum(x for x in pmf.values() if x <= pmf[a] * (1 + 1e-7)))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range by quadrature over the scale and the location."""
    if q <= 0:
        return 1.0

    def inner(w: float) -> float:
        steps = 160
        lo, hi = -8.0, 8.0
        h = (hi - lo) / steps
        total = 0.0
        for i in range(steps + 1):
            z = lo + i * h
            weight = 1 if i in (0, steps) else 4 if i % 2 else 2
            total += weight * k * _N.pdf(z) * (_N.cdf(z + w) - _N.cdf(z)) ** (k - 1)
        return total * h / 3

    if df > 5000:
        return max(0.0, 1 - inner(q))
    spread = 1 / math.sqrt(2 * df)
    lo, hi, steps = max(1e-6, 1 - 8 * spread), 1 + 8 * spread, 80
    h = (hi - lo) / steps
    logc = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2)
    total = 0.0
    for i in range(steps + 1):
        s = lo + i * h
        density = math.exp(logc + (df - 1) * math.log(s) - df * s * s / 2)
        total += (1 if i in (0, steps) else 4 if i % 2 else 2) * density * inner(q * s)
    return min(1.0, max(0.0, 1 - total * h / 3))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - studentized_range_sf(mid, k, df) < p else (lo, mid)
    return (lo + hi) / 2


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p by Royston's 1995 approximation; values sorted."""
    n = len(values)
    m = [normal_ppf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    ss = sum(x * x for x in m)
    u = 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = m[-1] / math.sqrt(ss) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        if n > 5:
            second = m[-2] / math.sqrt(ss) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *(x / math.sqrt(phi) for x in m[2:-2]), second, last]
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(x / math.sqrt(phi) for x in m[1:-1]), last]
    mean = sum(values) / n
    var = sum((x - mean) ** 2 for x in values)
    w = min(1.0, sum(x * y for x, y in zip(a, values, strict=True)) ** 2 / var) if var else 1.0
    return w, _shapiro_p(w, n)


def shapiro_wilk_sums(n: int, mm: float, mx: float, ends: tuple[float, float, float, float], var: float) -> tuple[float, float]:
    """The same for n over 5 from sums over all values: of squared normal scores, of scores times values and of squared
    deviations; ``ends`` are the two least and the two greatest values in order."""
    top, next_ = normal_ppf((n - 0.375) / (n + 0.25)), normal_ppf((n - 1.375) / (n + 0.25))
    u = 1 / math.sqrt(n)
    last = top / math.sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    second = next_ / math.sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (mm - 2 * top**2 - 2 * next_**2) / (1 - 2 * last**2 - 2 * second**2)
    outer, inner = ends[3] - ends[0], ends[2] - ends[1]
    ax = (mx - top * outer - next_ * inner) / math.sqrt(phi) + last * outer + second * inner
    w = min(1.0, ax**2 / var) if var else 1.0
    return w, _shapiro_p(w, n)


def _shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        y = -math.log(max(1e-300, g - math.log(max(1e-300, 1 - w))))
    else:
        x = math.log(n)
        mu = -1.5861 - 0.31082 * x - 0.083751 * x**2 + 0.0038915 * x**3
        sigma = math.exp(-0.4803 - 0.082676 * x + 0.0030302 * x**2)
        y = math.log(max(1e-300, 1 - w))
    return normal_sf((y - mu) / sigma)


def kendall_exact_p(n: int, out_of_order: int) -> float:
    """Two-sided p of at most ``out_of_order`` of the pairs of a random order of ``n`` being out of order (the smaller side)."""
    counts = [1.0]  # shares of orders with k pairs out of order, up to the wanted k
    for size in range(2, n + 1):
        grown = [0.0] * min(out_of_order + 1, len(counts) + size - 1)
        run = 0.0
        for k in range(len(grown)):
            run += counts[k] if k < len(counts) else 0.0
            if k >= size:
                run -= counts[k - size] if k - size < len(counts) else 0.0
            grown[k] = run / size
        counts = grown
    return min(1.0, 2 * sum(counts[: out_of_order + 1]))
