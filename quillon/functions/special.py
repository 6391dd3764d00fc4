"""Distribution functions in plain Python and numpy; everything statistical rests on these."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_N = NormalDist()
NAN = float("nan")


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _N.inv_cdf(p)


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    return np.vectorize(norm_cdf, otypes=[float])(x)


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if math.isnan(x):
        return NAN
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    return 1 - gammaincc(a, x) if x >= a + 1 else _gamma_series(a, x)


def gammaincc(a: float, x: float) -> float:
    if math.isnan(x):
        return NAN
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1 - _gamma_series(a, x)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def _gamma_series(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    for _ in range(100_000):
        n += 1
        term *= x / n
        total += term
        if term < total * 1e-17:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def t_sf(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return NAN
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    if math.isinf(df):
        return norm_sf(t)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_two(t: float, df: float) -> float:
    return min(1.0, 2 * t_sf(abs(t), df))


def t_pdf(t: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * math.log1p(t * t / df))


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return NAN
    if f <= 0:
        return 1.0
    return 0.0 if math.isinf(f) else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return NAN if math.isnan(x) or df <= 0 else 1.0 if x <= 0 else gammaincc(df / 2, x / 2)


def invert(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """x with cdf(x) = p for an increasing cdf; [low, high] is widened as needed (low only if negative)."""
    for _ in range(200):
        if cdf(high) >= p:
            break
        high = high * 2 + 1
    while low < 0 and cdf(low) > p:
        low = low * 2 - 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@lru_cache(maxsize=4096)
def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    return -t_ppf(1 - p, df) if p < 0.5 else invert(lambda x: 1 - t_sf(x, df), p, 0.0, 2.0)


@lru_cache(maxsize=4096)
def f_ppf(p: float, d1: float, d2: float) -> float:
    return invert(lambda x: 1 - f_sf(x, d1, d2), p, 0.0, 4.0)


@lru_cache(maxsize=4096)
def chi2_ppf(p: float, df: float) -> float:
    return invert(lambda x: gammainc(df / 2, x / 2), p, 0.0, df + 10)


def beta_ppf(p: float, a: float, b: float) -> float:
    return invert(lambda x: betainc(a, b, x), p, 0.0, 1.0)


def gamma_cdf(x: float, shape: float, scale: float) -> float:
    return gammainc(shape, x / scale) if x > 0 else 0.0


def binom_pmf(k: int, n: int, p: float) -> float:
    if k < 0 or k > n:
        return 0.0
    if p <= 0 or p >= 1:
        return float(k == (n if p >= 1 else 0))
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binom_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else betainc(n - k, k + 1, 1 - p)


def binom_two(k: int, n: int, p: float = 0.5) -> float:
    """Exact two-sided p: all outcomes no likelier than the one seen."""
    seen = binom_pmf(k, n, p) * (1 + 1e-7)
    return min(1.0, sum(q for i in range(n + 1) if (q := binom_pmf(i, n, p)) <= seen)) if n <= 2000 or p != 0.5 else min(1.0, 2 * binom_cdf(min(k, n - k), n, p))


def hypergeom_pmf(k: int, total: int, good: int, draws: int) -> float:
    if k < max(0, draws - (total - good)) or k > min(good, draws):
        return 0.0
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return math.exp(choose(good, k) + choose(total - good, draws - k) - choose(total, draws))


@lru_cache(maxsize=16)
def legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def integrate(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, n: int = 200) -> float:
    x, w = legendre(n)
    half = (high - low) / 2
    return float(half * np.dot(w, f(low + half * (x + 1))))


def _chi_scale(df: float, n: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for the law of chi_df / sqrt(df)."""
    if math.isinf(df) or df > 1e6:
        return np.array([1.0]), np.array([1.0])
    spread = 9 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - spread), 1 + spread
    x, w = legendre(n)
    s = low + (high - low) / 2 * (x + 1)
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return s, w * (high - low) / 2 * np.exp(log)


_ERF = np.vectorize(math.erf, otypes=[float])


def studentized_range_sf(q: float, k: int, df: float) -> float:
    if q <= 0:
        return 1.0
    s, ws = _chi_scale(df, 64)
    z, wz = legendre(96)
    z, wz = 8 * z, 8 * wz
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = 0.5 * (_ERF(z / math.sqrt(2))[None, :] - _ERF((z[None, :] - q * s[:, None]) / math.sqrt(2)))
    prob = k * (inner ** (k - 1)) @ (wz * phi)
    return float(min(1.0, max(0.0, 1 - np.dot(ws, prob))))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    low, high = 0.0, 10.0
    while 1 - studentized_range_sf(high, k, df) < p:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - studentized_range_sf(mid, k, df) < p else (low, mid)
    return (low + high) / 2


def dunnett_sf(t: float, loadings: list[float], df: float) -> float:
    """P(max |T_i| > t) for T with correlations loadings_i * loadings_j."""
    s, ws = _chi_scale(df, 48)
    z, wz = legendre(96)
    z, wz = 8 * z, 8 * wz
    phi = wz * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    prob = np.ones((len(s), len(z)))
    for a in loadings:
        r = math.sqrt(2 * (1 - a * a))
        prob *= 0.5 * (_ERF((abs(t) * s[:, None] + a * z[None, :]) / r) - _ERF((-abs(t) * s[:, None] + a * z[None, :]) / r))
    return float(min(1.0, max(0.0, 1 - np.dot(ws, prob @ phi))))


def nct_sf(t: float, df: float, nc: float) -> float:
    """Noncentral t upper tail."""
    s, w = _chi_scale(df, 160)
    return float(min(1.0, max(0.0, np.dot(w, 0.5 * (1 - _ERF((t * s - nc) / math.sqrt(2)))))))


def _poisson_mix(nc: float, tail: Callable[[int], float]) -> float:
    lam = nc / 2
    if lam <= 0:
        return tail(0)
    mid, total = int(lam), 0.0
    for step, start in ((1, mid), (-1, mid - 1)):
        j = start
        while j >= 0:
            weight = math.exp(-lam + j * math.log(lam) - math.lgamma(j + 1))
            total += weight * tail(j)
            if weight < 1e-15 and abs(j - mid) > 5:
                break
            j += step
    return min(1.0, total)


def ncf_sf(f: float, d1: float, d2: float, nc: float) -> float:
    return _poisson_mix(nc, lambda j: betainc(d2 / 2, d1 / 2 + j, d2 / (d2 + d1 * f)))


def ncx2_sf(x: float, df: float, nc: float) -> float:
    return _poisson_mix(nc, lambda j: gammaincc(df / 2 + j, x / 2))


def ks_sf(d: float, n: int) -> float:
    """P(D_n >= d): exact (Marsaglia-Tsang-Wang) for small samples, else the limit law with Stephens' correction."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n <= 140 and n * d * d < 18:
        k = int(n * d) + 1
        m, h = 2 * k - 1, k - n * d
        a = np.zeros((m, m))
        for i in range(m):
            for j in range(m):
                if i - j + 1 >= 0:
                    a[i, j] = 1
        for i in range(m):
            a[i, 0] -= h ** (i + 1)
            a[m - 1, i] -= h ** (m - i)
        a[m - 1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0
        for i in range(m):
            for j in range(m):
                if i - j + 1 > 0:
                    a[i, j] /= math.factorial(i - j + 1)
        power, shift, base, left = np.eye(m), 0, a, n
        base_shift = 0
        while left:
            if left & 1:
                power, shift = power @ base, shift + base_shift
            base, base_shift = base @ base, 2 * base_shift
            if base[m // 2, m // 2] > 1e140:
                base, base_shift = base * 1e-140, base_shift + 140
            if power[m // 2, m // 2] > 1e140:
                power, shift = power * 1e-140, shift + 140
            left >>= 1
        out = power[k - 1, k - 1]
        for i in range(1, n + 1):
            out *= i / n
            if out < 1e-140:
                out, shift = out * 1e140, shift - 140
        return float(min(1.0, max(0.0, 1 - out * 10.0**shift)))
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) if n < 3000 else d * math.sqrt(n)
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * x * x) for i in range(1, 101)))))


# Royston's polynomials for the W test (AS R94).
_SW = {
    "c1": (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056),
    "c2": (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633),
    "c3": (0.544, -0.39978, 0.025054, -6.714e-4),
    "c4": (1.3822, -0.77857, 0.062767, -0.0020322),
    "c5": (-1.5861, -0.31082, -0.083751, 0.0038915),
    "c6": (-0.4803, -0.082676, 0.0030302),
    "g": (-2.273, 0.459),
}


def _poly(name: str, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(_SW[name]))


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for 3 <= n <= 5000 sorted or unsorted values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if x[-1] == x[0]:
        return 1.0, 1.0
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        u = 1 / math.sqrt(n)
        last = _poly("c1", u) + m[-1] / math.sqrt(ssq)
        if n > 5:
            second = _poly("c2", u) + m[-2] / math.sqrt(ssq)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[[-1, -2, 0, 1]] = last, second, -last, -second
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[[-1, 0]] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean()))))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = _poly("g", n)
        if y >= gamma:
            return w, 1e-99
        y, mean, sd = -math.log(gamma - y), _poly("c3", n), math.exp(_poly("c4", n))
    else:
        log = math.log(n)
        mean, sd = _poly("c5", log), math.exp(_poly("c6", log))
    return w, norm_sf((y - mean) / sd)


@lru_cache(maxsize=64)
def _mann_whitney_counts(n1: int, n2: int) -> tuple[int, ...]:
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):  # multiply by (1 - q^(n2+i)) / (1 - q^i)
        for u in range(n1 * n2, n2 + i - 1, -1):
            counts[u] -= counts[u - n2 - i]
        for u in range(i, n1 * n2 + 1):
            counts[u] += counts[u - i]
    return tuple(counts)


def mann_whitney_exact(u: float, n1: int, n2: int, alternative: str = "two-sided") -> float:
    counts = _mann_whitney_counts(n1, n2)
    total = sum(counts)
    upper = sum(counts[math.ceil(u) :]) / total  # P(U >= u)
    lower = sum(counts[: math.floor(u) + 1]) / total
    return min(1.0, {"greater": upper, "less": lower}.get(alternative, 2 * min(upper, lower)))


@lru_cache(maxsize=64)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    counts = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(counts) - 1, r - 1, -1):
            counts[s] += counts[s - r]
    return tuple(counts)


def wilcoxon_exact(w: float, n: int) -> float:
    """Two-sided p of the smaller signed-rank sum."""
    counts = _signed_rank_counts(n)
    return min(1.0, 2 * sum(counts[: math.floor(w) + 1]) / sum(counts))


@lru_cache(maxsize=64)
def _inversion_counts(n: int) -> tuple[int, ...]:
    counts = [1]
    for i in range(2, n + 1):
        new = [0] * (len(counts) + i - 1)
        for j, c in enumerate(counts):
            for s in range(i):
                new[j + s] += c
        counts = new
    return tuple(counts)


def kendall_exact(discordant: int, n: int) -> float:
    counts = _inversion_counts(n)
    total, c = sum(counts), min(discordant, n * (n - 1) // 2 - discordant)
    return min(1.0, 2 * sum(counts[: c + 1]) / total)


# MacKinnon's response surface for the constant-only unit-root test, and the KPSS table.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.04), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
KPSS_TABLE = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def adf_p(tau: float) -> float:
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    return norm_cdf(sum(c * tau**i for i, c in enumerate(ADF_SMALL if tau <= ADF_STAR else ADF_LARGE)))
