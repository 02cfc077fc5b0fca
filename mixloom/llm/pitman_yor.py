"""Seating numbers of Pitman-Yor restaurants: Gibbs draws of how many tables serve a dish.

Given all else, the tables t of a dish of c customers have P(t) proportional to S(c, t) times the product over j < t of
(a + d j) p, where S are generalised Stirling numbers: c! / t! times the coefficient of x^c in f(x)^t, with
f(x) = (1 - (1 - x)^d) / d. Up to EXACT customers S comes from its recursion. Beyond, it comes from the binomial
expansion of f^t for few tables and from the saddlepoint of the coefficient for many; both are the same law, whatever c.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from mixloom.llm.arrow import mixed

#: Customers up to which S is taken from a table of the recursion.
EXACT = 128
#: Tables up to which the expansion serves beyond that, and points at which a law is evaluated around its mode.
FEW, POINTS = 32, 256


@lru_cache(maxsize=64)
def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t), by S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, most + 1):
            t = np.arange(1, c + 1)
            out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], np.log(np.maximum(c - 1 - d * t, 1e-300)) + out[c - 1, 1 : c + 1])
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series from 8 on."""
    x = np.asarray(x, float)
    low = x < 8
    shift = np.where(low, np.log(np.abs(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))), 0.0) if low.any() else 0.0
    x = np.where(low, x + 8, x)
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x - shift


@lru_cache(maxsize=64)
def _expansion(d: float) -> np.ndarray:
    """(t, j): (-1)^j binomial(t, j) / Gamma(-d j), for t and j up to FEW."""
    from math import comb, gamma, lgamma as lg, pi, sin

    over = [0.0]  # 1 / Gamma(-x) = -Gamma(1 + x) sin(pi x) / pi
    for j in range(1, FEW + 1):
        x = d * j
        over.append(-np.exp(lg(1 + x)) * sin(pi * x) / pi if x > 20 else -gamma(1 + x) * sin(pi * x) / pi)
    return np.array([[(-1) ** j * comb(t, j) * over[j] for j in range(FEW + 1)] for t in range(FEW + 1)])


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) from the saddlepoint of the coefficient of x^c in f(x)^t; y is 1 - x there.

    With few customers beyond the tables (rest), the coefficient is as good as a Poisson one, whose own saddlepoint error is known.
    """
    rest = c - t
    c = np.where(rest < 0.5, t + 1, c)  # S(c, c) = 1 is put in at the end
    k = np.log(c / t)
    u = np.minimum((np.log(d) - k) / (1 - d), -1e-9)  # log y
    for _ in range(12):
        y = np.exp(u)
        yd = np.exp(d * u)
        miss = np.log(d) + np.log1p(-y) + (d - 1) * u - np.log1p(-yd) - k
        slope = -y / (1 - y) + (d - 1) + d * yd / (1 - yd)
        u = np.minimum(u - miss / np.minimum(slope, -1e-9), u / 8)  # y stays below 1
    y, yd = np.exp(u), np.exp(d * u)
    r, f = 1 - y, (1 - yd) / d
    g = r * np.exp((d - 1) * u) / f
    spread = t * (g + r * r * (1 - d) * np.exp((d - 2) * u) / f - g * g)
    out = lgamma(c + 1.0) - lgamma(t + 1.0) + t * np.log(f) - c * np.log1p(-y) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))
    n = np.maximum(rest, 1.0)
    out = np.where(rest < t, out + n * np.log(n) - n + 0.5 * np.log(2 * np.pi * n) - lgamma(n + 1.0), out)
    return np.where(rest < 0.5, 0.0, out)


def log_weights(c: np.ndarray, t: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, flat: bool = False) -> np.ndarray:
    """log P(t) up to a constant of each row, for a row of table numbers t for each dish (1 <= t <= c). flat: every table weighs a."""
    c, t = np.asarray(c, float)[:, None], np.asarray(t, float)
    out = _saddle(np.broadcast_to(c, t.shape), t, d)
    if (t <= FEW).any():
        j = np.arange(1, FEW + 1)
        base = lgamma(c - d)
        part = np.concatenate([np.zeros_like(c), np.exp(lgamma(c - d * j) - base)], axis=1)
        b = _expansion(d)
        total, size = part @ b.T, part @ np.abs(b).T
        ok = total > 1e-8 * size
        log_s = np.where(ok, np.log(np.where(ok, total, 1.0)), 0) + base - np.arange(FEW + 1) * np.log(d) - lgamma(np.arange(FEW + 1) + 1.0)
        at = np.minimum(t, FEW).astype(np.int64)
        rows = np.arange(len(t))[:, None]
        out = np.where((t <= FEW) & ok[rows, at], log_s[rows, at], out)
    if flat:
        return out + t * np.log(np.maximum(np.asarray(a, float) * np.asarray(p, float), 1e-300))[:, None]
    e = np.asarray(a, float)[:, None] / d
    return out + t * np.log(d) + lgamma(e + t) - lgamma(e) + t * np.log(np.maximum(np.asarray(p, float), 1e-300))[:, None]


def uniforms(keys: np.ndarray, k: int) -> np.ndarray:
    """Repeatable numbers in (0, 1) for 64-bit keys, so a lost executor's rerun draws the same."""
    return ((mixed(keys + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _draw_many(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, u: np.ndarray, flat: bool) -> np.ndarray:
    """Draws for large dishes: the mode by narrowing grids, then the law on up to POINTS points some nine deviations around it."""
    lo, hi = np.ones(len(c)), c.astype(float)
    for _ in range(24):
        grid = np.round(lo[:, None] * (hi / lo)[:, None] ** np.linspace(0, 1, 9))
        best = np.argmax(log_weights(c, grid, a, p, d, flat), axis=1)
        rows = np.arange(len(c))
        lo, hi = grid[rows, np.maximum(best - 1, 0)], grid[rows, np.minimum(best + 1, 8)]
        if (hi - lo <= 2).all():
            break
    mode = np.round((lo + hi) / 2)
    h = np.maximum(1.0, np.round(mode / 64))
    around = np.clip(np.stack([mode - h, mode, mode + h], axis=1), 1, c[:, None])
    v = log_weights(c, around, a, p, d, flat)
    bend = np.maximum(-(v[:, 0] - 2 * v[:, 1] + v[:, 2]) / (h * h), 1e-12)
    sd = np.where(around[:, 0] < around[:, 1], 1 / np.sqrt(bend), mode + 4)
    reach = np.minimum(9 * np.minimum(sd, 2 * mode + 8) + 12, c)
    low, high = np.maximum(1, np.floor(mode - reach)), np.minimum(c, np.ceil(mode + reach))
    stride = np.ceil((high - low + 1) / POINTS)
    n = int(np.ceil((high - low + 1) / stride).max())
    begin = low[:, None] + stride[:, None] * np.arange(n)
    inside = begin <= high[:, None]
    middle = np.minimum(begin + (stride[:, None] - 1) / 2, c[:, None])
    w = np.where(inside, log_weights(c, np.minimum(middle, c[:, None]), a, p, d, flat), -np.inf)
    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    x = u * w[:, -1]
    k = (w < x[:, None]).sum(axis=1)
    rows = np.arange(len(c))
    before = np.where(k > 0, w[rows, np.maximum(k - 1, 0)], 0.0)
    part = (x - before) / np.maximum(w[rows, k] - before, 1e-300)
    return np.minimum(begin[rows, k] + np.floor(part * stride), high)


def draw_tables(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, keys: np.ndarray, flat: bool = False) -> np.ndarray:
    """Tables for dishes of c customers in restaurants whose weight for a new table is a, the parent's probability being p.

    flat: all new tables of a dish have the weight a, instead of a, a + d, a + 2 d and so on. With a = d x and x drawn from the gamma
    law of shape strength / d + all tables, the dishes of a restaurant are independent of each other, and draws of all at once are exact.
    """
    t = np.minimum(c, 1).astype(np.int64)
    u = uniforms(keys, 0)
    log_s = log_stirling(d)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    for i in range(0, len(few), 20_000):
        at = few[i : i + 20_000]
        most = int(c[at].max())
        j = np.arange(most)
        w = log_s[c[at], 1 : most + 1] + np.cumsum(np.log(a[at][:, None] + (0 if flat else d) * j) + np.log(np.maximum(p[at], 1e-300))[:, None], axis=1)
        w = np.exp(w - w.max(axis=1, keepdims=True))
        w = np.cumsum(w, axis=1)
        t[at] = 1 + (w < u[at][:, None] * w[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    for i in range(0, len(many), 4000):
        at = many[i : i + 4000]
        t[at] = _draw_many(c[at], a[at], p[at], d, u[at], flat).astype(np.int64)
    return t
