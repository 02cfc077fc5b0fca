"""Bounded Nelder-Mead, golden section, finite differences and convergence checks."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Optimum:
    par: np.ndarray
    value: float
    evaluations: int
    converged: bool
    message: str = ""
    name: str = ""
    messages: list[str] = field(default_factory=list)


def golden(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-9, most: int = 200) -> Optimum:
    k = (5**0.5 - 1) / 2
    a, b = hi - k * (hi - lo), lo + k * (hi - lo)
    fa, fb, n = f(a), f(b), 2
    while hi - lo > tol and n < most:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - k * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + k * (hi - lo)
            fb = f(b)
        n += 1
    x, v = (a, fa) if fa < fb else (b, fb)
    return Optimum(np.array([x]), v, n, hi - lo <= tol)


def brent(f: Callable[[float], float], lo: float, hi: float, start: float, tol: float = 1e-7, most: int = 200) -> Optimum:
    """Parabolic steps from start inside the bracket, golden ones where those fail."""
    k = (3 - 5**0.5) / 2
    x = w = v = start
    fx = fw = fv = f(x)
    n, step, last = 1, 0.0, 0.0
    while n < most:
        mid, t = (lo + hi) / 2, tol / 3 + 1e-9 * abs(x)
        if abs(x - mid) <= 2 * t - (hi - lo) / 2:
            return Optimum(np.array([x]), fx, n, True)
        r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
        p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
        p, q = (-p, q) if q > 0 else (p, -q)
        if abs(last) > t and abs(p) < abs(q * last / 2) and q * (lo - x) < p < q * (hi - x):
            last, step = step, p / q
            if x + step - lo < 2 * t or hi - x - step < 2 * t:
                step = t if x < mid else -t
        else:
            last = hi - x if x < mid else lo - x
            step = k * last
        u = x + (step if abs(step) >= t else np.copysign(t, step))
        fu = f(u)
        n += 1
        if fu <= fx:
            lo, hi = (x, hi) if u >= x else (lo, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            lo, hi = (u, hi) if u < x else (lo, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return Optimum(np.array([x]), fx, n, False)


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, up: np.ndarray, step: float | np.ndarray = 0.02, most: int = 10_000, ftol: float = 1e-11, xtol: float = 1e-7) -> Optimum:
    """Points outside the box are moved onto it. Restarts once from its optimum, against early collapse.

    step is the simplex's first size, by coordinate if an array; most counts evaluations.
    """
    step = np.broadcast_to(np.asarray(step, float), np.shape(start))
    clip = lambda x: np.minimum(np.maximum(x, low), up)
    n, used = len(start), 0

    def run(at: np.ndarray, size: np.ndarray):
        nonlocal used
        pts = [clip(at)]
        for i in range(n):
            x = at.copy()
            x[i] += size[i] if clip(x + size * np.eye(n)[i])[i] != x[i] else -size[i]
            pts.append(clip(x))
        vals = [f(x) for x in pts]
        used += n + 1
        while used < most:
            order = np.argsort(vals)
            pts, vals = [pts[i] for i in order], [vals[i] for i in order]
            if vals[-1] - vals[0] <= ftol * (abs(vals[0]) + ftol) and max(np.abs(x - pts[0]).max() for x in pts) < 1e-4 or max(np.abs(x - pts[0]).max() for x in pts) < xtol:
                return pts[0], vals[0], True
            mid = np.mean(pts[:-1], axis=0)
            x = clip(2 * mid - pts[-1])
            v = f(x)
            used += 1
            if v < vals[0]:
                y = clip(3 * mid - 2 * pts[-1])
                w = f(y)
                used += 1
                x, v = (y, w) if w < v else (x, v)
            elif v >= vals[-2]:
                y = clip(0.5 * (mid + (x if v < vals[-1] else pts[-1])))
                w = f(y)
                used += 1
                if w < min(v, vals[-1]):
                    x, v = y, w
                else:
                    pts = [pts[0]] + [0.5 * (p + pts[0]) for p in pts[1:]]
                    vals = [vals[0]] + [f(p) for p in pts[1:]]
                    used += n
                    continue
            pts[-1], vals[-1] = x, v
        i = int(np.argmin(vals))
        return pts[i], vals[i], False

    x, v, ok = run(np.asarray(start, float), step)
    x2, v2, ok = run(x, step / 4)
    return Optimum(x2 if v2 <= v else x, min(v, v2), used, ok)


def quadratic(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, up: np.ndarray, radius: float = 0.2, least: float = 1e-8, most: int = 5000) -> Optimum:
    """Derivative-free trust region: a quadratic of least curvature through the points around the best one is minimised in a box.

    The box is that of the bounds within the radius, which grows after good steps and halves after bad ones.
    """
    n, used = len(start), 0
    clip = lambda x: np.minimum(np.maximum(x, low), up)
    pts, vals = [], []

    def put(x: np.ndarray) -> float:
        nonlocal used
        used += 1
        v = float(f(x))
        pts.append(x)
        vals.append(v if np.isfinite(v) else 1e300)
        return vals[-1]

    def spread(x: np.ndarray, r: float) -> None:
        for i in range(n):
            for sign in (1, -1):
                y = clip(x + sign * r * np.eye(n)[i])
                if y[i] != x[i]:
                    put(y)

    x = clip(np.asarray(start, float))
    put(x)
    spread(x, radius)
    want = (n + 1) * (n + 2) // 2
    iu = np.triu_indices(n)
    while used < most and radius > least:
        i = int(np.argmin(vals))
        x, best = pts[i], vals[i]
        dist = np.array([np.abs(p - x).max() for p in pts])
        near = np.argsort(dist, kind="stable")[: want + n]
        near = near[dist[near] <= 4 * radius]
        if len(near) < 2 * n + 1:
            spread(x, radius)
            radius *= 0.999
            continue
        d = (np.array([pts[k] for k in near]) - x) / radius
        y = np.array([vals[k] for k in near]) - best
        ok = y < 1e250
        d, y = d[ok], y[ok]
        curve = d[:, iu[0]] * d[:, iu[1]] * np.where(iu[0] == iu[1], 0.5, 1.0)
        sol = np.linalg.lstsq(np.column_stack([d, curve]), y, rcond=1e-10)[0]
        g, h = sol[:n], np.zeros((n, n))
        h[iu] = sol[n:]
        h = h + np.triu(h, 1).T
        lo, hi = np.maximum((low - x) / radius, -1), np.minimum((up - x) / radius, 1)
        s = np.zeros(n)
        for _ in range(60):  # coordinate by coordinate within the box
            before = s.copy()
            for k in range(n):
                slope = g[k] + h[k] @ s - h[k, k] * s[k]
                options = [lo[k], hi[k]] + ([min(max(-slope / h[k, k], lo[k]), hi[k])] if h[k, k] > 0 else [])
                s[k] = min(options, key=lambda t, k=k, slope=slope: slope * t + 0.5 * h[k, k] * t * t)
            if np.abs(s - before).max() < 1e-9:
                break
        gain = -(g @ s + 0.5 * s @ h @ s)
        size = np.abs(s).max()
        if size < 0.05 or gain <= 1e-15 * (1 + abs(best)):
            radius *= 0.25
            spread(x, radius)
            if gain <= 1e-13 * (1 + abs(best)) and radius < 1e-5:
                break
            continue
        v = put(clip(x + radius * s))
        ratio = (best - v) / gain
        radius *= 2.0 if ratio > 0.7 and size > 0.9 else 1.0 if ratio > 0.1 else 0.5
    i = int(np.argmin(vals))
    return Optimum(pts[i], vals[i], used, used < most, name="quadratic")


def quasi_newton(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, up: np.ndarray, most: int = 500, tol: float = 1e-10) -> Optimum:
    """Projected quasi-Newton steps with gradients by central differences and a halving line search."""
    n, used = len(start), 0
    clip = lambda x: np.minimum(np.maximum(x, low), up)

    def value(x: np.ndarray) -> float:
        nonlocal used
        used += 1
        v = float(f(x))
        return v if np.isfinite(v) else 1e300

    def slope(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for i in range(n):
            e = np.eye(n)[i] * 1e-5 * max(1.0, abs(x[i]))
            a, b = clip(x + e), clip(x - e)
            out[i] = (value(a) - value(b)) / (a[i] - b[i])
        return out

    x = clip(np.asarray(start, float))
    v, g, h = value(x), slope(x), np.eye(n)
    for step in range(most):
        free = ~(((x <= low) & (g > 0)) | ((x >= up) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-7:
            break
        d = np.zeros(n)
        d[free] = -h[np.ix_(free, free)] @ g[free]
        if d @ g >= 0:
            h, d = np.eye(n), np.where(free, -g, 0.0)
        t = min(1.0, 1.0 / max(1e-12, np.abs(d).max())) if not step else 1.0
        for _ in range(40):
            y = clip(x + t * d)
            w = value(y)
            if w <= v + 1e-4 * g @ (y - x):
                break
            t /= 2
        else:
            break
        new = slope(y)
        s, z = y - x, new - g
        if s @ z > 1e-12:
            rho = 1 / (s @ z)
            m = np.eye(n) - rho * np.outer(s, z)
            h = m @ h @ m.T + rho * np.outer(s, s)
        done = abs(v - w) <= tol * (abs(v) + tol)
        x, v, g = y, w, new
        if done:
            break
    return Optimum(x, v, used, True, name="quasi-newton")


#: Optimizers by name: each takes (f, start, lower, upper, **options).
OPTIMIZERS: dict[str, Callable] = {"quadratic": quadratic, "simplex": nelder_mead, "quasi-newton": quasi_newton, "wide simplex": lambda f, x, lo, up, **o: nelder_mead(f, x, lo, up, **({"step": 0.5} | o))}


def optimizer_of(name: str | Callable) -> Callable:
    if callable(name):
        return name
    if name not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {name!r}: one of {', '.join(OPTIMIZERS)}")
    return OPTIMIZERS[name]


def optimize(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, up: np.ndarray, optimizer: str | Callable = "quadratic", options: dict | None = None, restart_edge: bool = True, boundary_tol: float = 1e-5) -> Optimum:
    """One search by any optimizer: warnings are kept as messages; an optimum on a bound that the slope leads away from is
    sought again from inside; coordinates near a bound are moved onto it if that is no worse; the value is evaluated anew."""
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        opt = optimizer_of(optimizer)(f, np.asarray(start, float), low, up, **(options or {}))
        if not isinstance(opt, Optimum):  # a foreign optimizer may answer with (parameters, value)
            opt = Optimum(np.asarray(opt[0], float), float(opt[1]), 0, True)
        at = np.flatnonzero((opt.par == low) | (opt.par == up))
        if restart_edge and len(at):
            x = opt.par.copy()
            moved = False
            for i in at:
                y = opt.par.copy()
                y[i] += 1e-5 if opt.par[i] == low[i] else -1e-5
                if f(y) < opt.value:
                    x[i] += 1e-3 if opt.par[i] == low[i] else -1e-3
                    moved = True
            if moved:
                again = optimizer_of(optimizer)(f, x, low, up, **(options or {}))
                if isinstance(again, Optimum) and again.value < opt.value:
                    opt = again
        opt = snap(f, opt, low, up, boundary_tol)
    opt.messages = [str(w.message) for w in seen]
    opt.value = float(f(opt.par))
    opt.name = optimizer if isinstance(optimizer, str) else getattr(optimizer, "__name__", "user")
    return opt


def derivatives(f: Callable[[np.ndarray], float], x: np.ndarray, delta: float = 1e-4, low: np.ndarray | None = None, up: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian by central differences; where a bound is nearer than a step, by steps away from it. A step is delta,
    or a hundredth of a small coordinate."""
    x = np.asarray(x, float)
    n, f0 = len(x), f(x)
    low, up = (np.full(n, v) if b is None else b for b, v in ((low, -np.inf), (up, np.inf)))
    d = np.where(np.abs(x) > 1e-6, np.minimum(delta, 0.01 * np.abs(x)), delta)
    lo_side, hi_side = x - d < low, x + d > up
    a = np.where(lo_side, 0.0, np.where(hi_side, -2 * d, -d))  # the lowest of three points by coordinate
    e = np.eye(n)
    get = lambda i, s: f0 if s == 0 else f(x + s * e[i])
    g, h = np.zeros(n), np.zeros((n, n))
    for i in range(n):
        v = [get(i, a[i]), get(i, a[i] + d[i]), get(i, a[i] + 2 * d[i])]
        h[i, i] = (v[0] - 2 * v[1] + v[2]) / d[i] ** 2
        g[i] = (v[0] - 4 * v[1] + 3 * v[2] if hi_side[i] and not lo_side[i] else -3 * v[0] + 4 * v[1] - v[2] if lo_side[i] else v[2] - v[0]) / (2 * d[i])
        for j in range(i):
            s, t = a[i] + 2 * d[i], a[j] + 2 * d[j]
            h[i, j] = h[j, i] = (f(x + s * e[i] + t * e[j]) - f(x + s * e[i] + a[j] * e[j]) - f(x + a[i] * e[i] + t * e[j]) + f(x + a[i] * e[i] + a[j] * e[j])) / (4 * d[i] * d[j])
    return g, h


def check_hessian(h: np.ndarray, tol: float = 1e-6) -> list[tuple[int, str]]:
    """Remarks on a Hessian by its eigenvalues, each with its code: -6 not finite, -5 negative, -4 near zero, 2 and 3 badly scaled."""
    if not np.isfinite(h).all():
        return [(-6, "the Hessian is not finite")]
    v = np.linalg.eigvalsh(h)
    if v.min() < -tol:
        return [(-5, f"the Hessian has {int((v < -tol).sum())} negative eigenvalues")]
    if v.min() < tol:
        return [(-4, "the Hessian is numerically singular")]
    out = []
    if v.max() * tol > 1:
        out.append((2, "very large eigenvalue: consider scaling variables"))
    if v.min() / v.max() < tol:
        out.append((3, "eigenvalues of very different size: consider scaling variables"))
    return out


def snap(f: Callable[[np.ndarray], float], opt: Optimum, low: np.ndarray, up: np.ndarray, tol: float = 1e-5) -> Optimum:
    """Moves coordinates near a bound onto it where that is no worse."""
    x, v = opt.par.copy(), opt.value
    for i in range(len(x)):
        for bound in (low[i], up[i]):
            if np.isfinite(bound) and 0 < abs(x[i] - bound) < 1e-2:
                y = x.copy()
                y[i] = bound
                w = f(y)
                if w <= v + (tol if abs(x[i] - bound) < tol else 0.0):
                    x, v = y, w
    return Optimum(x, v, opt.evaluations, opt.converged, opt.message)


def check_convergence(f: Callable[[np.ndarray], float], opt: Optimum, low: np.ndarray, up: np.ndarray, grad_tol: float = 2e-3, singular_tol: float = 1e-4, hessian_tol: float = 1e-6) -> list[str]:
    return [m for _, m in convergence(f, opt, low, up, grad_tol, singular_tol, hessian_tol)]


def convergence(f: Callable[[np.ndarray], float], opt: Optimum, low: np.ndarray, up: np.ndarray, grad_tol: float = 2e-3, singular_tol: float = 1e-4, hessian_tol: float = 1e-6) -> list[tuple[int, str]]:
    """Remarks with codes: 0 singular fit (then nothing else is asked), -1 gradient, those of the Hessian, -3 no derivatives."""
    if (np.minimum(opt.par - low, up - opt.par) < singular_tol).any():
        return [(0, "boundary (singular) fit")]
    g, h = derivatives(f, opt.par, low=low, up=up)
    if not np.isfinite(g).all():
        return [(-3, "derivatives are not finite")]
    out = []
    try:
        scaled = np.abs(np.linalg.solve(np.linalg.cholesky(h), g)).max()
    except np.linalg.LinAlgError:
        scaled = np.inf
    if min(scaled, np.abs(g).max()) > grad_tol:
        out.append((-1, f"gradient {np.abs(g).max():.3g} above tolerance, component {int(np.argmax(np.abs(g))) + 1}"))
    return out + check_hessian(h, hessian_tol)
