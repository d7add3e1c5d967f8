"""Tail areas and quantiles of the t, F, chi-squared and studentized range laws.

Vectorised numpy on result-sized columns (one value per test, never per raw
row). Textbook forms: continued fraction for the incomplete beta, series and
continued fraction for the incomplete gamma, Gauss-Legendre nodes for the
double integral of the studentized range (Copenhaver & Holland 1988). Degrees
of freedom grow with the data, so every function also holds for df ~ 1e12.
"""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300
_EPS = 1e-15
_SETTLED = 1e-9  # a series, fraction or step that has not come this close gives NaN
_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def _lgamma(a):
    return np.asarray(_log_gamma(a), dtype=float)


def _log_gamma_ratio(big, add):
    """ln Γ(big+add) − ln Γ(big), without cancellation when ``big`` is large."""
    big, add = np.broadcast_arrays(np.asarray(big, float), np.asarray(add, float))
    out = np.empty(big.shape)
    large = big > 1e4
    if (~large).any():
        out[~large] = _lgamma(big[~large] + add[~large]) - _lgamma(big[~large])
    if large.any():
        b, a = big[large], add[large]
        top = a + b
        out[large] = (
            (top - 0.5) * np.log1p(a / b)
            + a * np.log(b)
            - a
            + (1 / top - 1 / b) / 12
            - (1 / top**3 - 1 / b**3) / 360
        )
    return out


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta, evaluated forward (Lentz)."""
    limit = 200 + int(20 * math.sqrt(float(np.max(np.maximum(a, b), initial=1.0))))
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, limit):
        step = np.ones_like(x)
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < _EPS * 10):
            break
    return np.where(np.abs(step - 1) < _SETTLED, h, np.nan)


def _beta_direct(a, b, x, y):
    big, small = np.maximum(a, b), np.minimum(a, b)
    log_beta = _lgamma(small) - _log_gamma_ratio(big, small)
    log_x = np.where(y < 0.5, np.log1p(-y), np.log(x))
    log_y = np.where(x < 0.5, np.log1p(-x), np.log(y))
    front = np.exp(a * log_x + b * log_y - log_beta) / a
    return front * _beta_fraction(a, b, x)


def regularized_beta(a, b, x, y):
    """I_x(a, b) with y = 1 − x given separately, so that neither end loses digits."""
    a, b, x, y = (v.astype(float).copy() for v in np.broadcast_arrays(a, b, x, y))
    out = np.full(x.shape, np.nan)
    known = np.isfinite(x) & np.isfinite(y) & (a > 0) & (b > 0)
    out[known & (x <= 0)] = 0.0
    out[known & (y <= 0)] = 1.0
    rest = known & (x > 0) & (y > 0)

    def asymptotic(big, small):
        middle = big + (small - 1) / 2
        return (big > 5e4) & (np.maximum(small, 1) ** 3 < 1e-8 * middle**2)

    for swap in (False, True):
        p, q, u, v = (b, a, y, x) if swap else (a, b, x, y)
        use = rest & asymptotic(p, q)
        if use.any():
            middle = p[use] + (q[use] - 1) / 2
            log_u = np.where(v[use] < 0.5, np.log1p(-np.minimum(v[use], 0.5)), np.log(u[use]))
            tail = upper_gamma(q[use], -middle * log_u)
            out[use] = 1 - tail if swap else tail
            rest = rest & ~use
    low = rest & (x <= (a + 1) / (a + b + 2))
    if low.any():
        out[low] = _beta_direct(a[low], b[low], x[low], y[low])
    high = rest & ~low
    if high.any():
        out[high] = 1 - _beta_direct(b[high], a[high], y[high], x[high])
    return np.clip(out, 0.0, 1.0)


def upper_gamma(a, x):
    """Q(a, x), the upper regularized incomplete gamma."""
    a, x = (v.astype(float).copy() for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    known = (a > 0) & (x >= 0) & ~np.isnan(x)
    out[known & (x == 0)] = 1.0
    out[known & np.isinf(x)] = 0.0
    live = known & (x > 0) & np.isfinite(x)
    series = live & (x < a + 1)
    if series.any():
        s, z = a[series], x[series]
        term = 1 / s
        total = term.copy()
        k = s.copy()
        for _ in range(200 + int(20 * math.sqrt(float(s.max())))):
            k = k + 1
            term = term * z / k
            total = total + term
            if np.all(term < total * _EPS):
                break
        total = np.where(term < total * _SETTLED, total, np.nan)
        out[series] = 1 - total * np.exp(s * np.log(z) - z - _lgamma(s))
    rest = live & ~series
    if rest.any():
        s, z = a[rest], x[rest]
        b = z + 1 - s
        c = np.full_like(z, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 200 + int(20 * math.sqrt(float(s.max())))):
            num = -i * (i - s)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
            if np.all(np.abs(step - 1) < _EPS * 10):
                break
        h = np.where(np.abs(step - 1) < _SETTLED, h, np.nan)
        out[rest] = np.exp(s * np.log(z) - z - _lgamma(s)) * h
    return np.clip(out, 0.0, 1.0)


def t_two_sided(t, df):
    """P(|T| > |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        square = t * t
        return regularized_beta(df / 2, 0.5, df / (df + square), square / (df + square))


def f_upper(f, df1, df2):
    """P(F > f)."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    with np.errstate(all="ignore"):
        whole = df2 + df1 * f
        return regularized_beta(df2 / 2, df1 / 2, df2 / whole, df1 * f / whole)


def chi2_upper(x, df):
    """P(chi-squared > x); a statistic below zero by rounding counts as zero."""
    x, df = np.asarray(x, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        return upper_gamma(df / 2, np.maximum(x, 0.0) / 2)


_STEP = 1 / 64
_NODES = np.arange(-12 * 64, 12 * 64 + 1) * _STEP
_CDF = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in _NODES])


def normal_cdf(x):
    """Φ(x): Taylor step of degree six from the nearest node of a computed table."""
    x = np.clip(np.asarray(x, float), -12.0, 12.0)
    with np.errstate(invalid="ignore"):
        index = np.nan_to_num(np.rint((x + 12.0) / _STEP)).astype(int)
    z = _NODES[index]
    d = x - z
    density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    z2 = z * z
    poly = d * (
        1
        - d / 2 * z
        + d**2 / 6 * (z2 - 1)
        - d**3 / 24 * z * (z2 - 3)
        + d**4 / 120 * (z2 * z2 - 6 * z2 + 3)
        - d**5 / 720 * z * (z2 * z2 - 10 * z2 + 15)
    )
    return _CDF[index] + density * poly


_INNER_NODE, _INNER_WEIGHT = np.polynomial.legendre.leggauss(128)
_OUTER_NODE, _OUTER_WEIGHT = np.polynomial.legendre.leggauss(96)


def _range_cdf_normal(w, k):
    """P(range of k standard normals <= w)."""
    z = 8.5 * _INNER_NODE
    weight = 8.5 * _INNER_WEIGHT * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    gap = normal_cdf(z)[None, :] - normal_cdf(z[None, :] - w[:, None])
    return k * ((np.maximum(gap, 0.0) ** (k - 1)[:, None]) @ weight)


_GRID = 1 / 128


def _range_cdf_table(k):
    return _range_cdf_normal(np.arange(0, 24, _GRID), np.full(24 * 128, float(k)))


def _interpolate(table, w):
    """Four-point interpolation in a table of step ``_GRID`` (error below 1e-9)."""
    w = np.minimum(w, 23.9)
    left = np.clip((w / _GRID).astype(int), 1, len(table) - 3)
    d = w / _GRID - left
    return (
        -table[left - 1] * d * (d - 1) * (d - 2) / 6
        + table[left] * (d + 1) * (d - 1) * (d - 2) / 2
        - table[left + 1] * (d + 1) * d * (d - 2) / 2
        + table[left + 2] * (d + 1) * d * (d - 1) / 6
    )


def _range_upper_one_k(q, k, df):
    table = _range_cdf_table(k)
    half = 9 / np.sqrt(2 * df)[:, None]
    low, high = np.maximum(0.0, 1 - half), 1 + half
    s = 0.5 * (high - low) * _OUTER_NODE + 0.5 * (high + low)
    half_df = df[:, None] / 2
    # s = 1 is the scale of the density; constants drop out when normalised
    log_density = (df[:, None] - 1) * np.log(s) - half_df * (s * s - 1)
    weight = _OUTER_WEIGHT * np.exp(log_density - log_density.max(axis=1, keepdims=True))
    weight = weight / weight.sum(axis=1, keepdims=True)
    return 1 - (weight * _interpolate(table, q[:, None] * s)).sum(axis=1)


def range_upper(q, k, df):
    """P(studentized range of k means > q)."""
    q, k, df = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(q, k, df))
    out = np.full(q.shape, np.nan)
    known = ~np.isnan(q) & (k >= 2) & (df > 0)
    two = known & (k == 2)
    if two.any():
        out[two] = t_two_sided(q[two] / math.sqrt(2), df[two])
    for levels in np.unique(k[known & (k > 2)]):
        rows = np.flatnonzero(known & (k == levels))
        for part in np.array_split(rows, 1 + len(rows) // 4096):
            out[part] = _range_upper_one_k(np.abs(q[part]), levels, df[part])
    return np.clip(out, 0.0, 1.0)


def t_quantile(level, df):
    """Two-sided critical value: P(|T| > t) = 1 − level."""
    from statistics import NormalDist

    level, df = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(level, df))
    out = np.full(df.shape, np.nan)
    ok = (df > 0) & (level > 0) & (level < 1)
    if not ok.any():
        return out
    alpha, v = 1 - level[ok], df[ok]
    z = np.array([NormalDist().inv_cdf(1 - a / 2) for a in alpha])
    t = (
        z
        + (z**3 + z) / (4 * v)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    )
    t = np.where(v <= 1, np.tan(math.pi / 2 * (1 - alpha)), t)
    t = np.where(v == 2, np.sqrt(2 * (1 - alpha) ** 2 / (alpha * (2 - alpha))), t)
    log_scale = _log_gamma_ratio(v / 2, 0.5) - 0.5 * np.log(v * math.pi)
    for _ in range(12):
        density = np.exp(log_scale - (v + 1) / 2 * np.log1p(t * t / v))
        move = (t_two_sided(t, v) - alpha) / (2 * density)
        move = np.where((v > 1e5) | (v == 2), 0.0, np.clip(move, -0.5 * t, 0.5 * t))
        t = t + move
        if np.all(np.abs(move) < 1e-14 * np.abs(t)):
            break
    out[ok] = np.where(np.abs(move) <= _SETTLED * np.abs(t), t, np.nan)
    return out
