"""Penalised least squares on the sums: profiled deviance, coefficients, conditional modes and their variances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mixloom.operators.gram import MOST_DENSE, Gram, unpack
from mixloom.plans.design import Spec

#: Levels of the largest factor that are eliminated at a time.
CHUNK = 2048


@dataclass
class Solution:
    beta: np.ndarray
    b: list[np.ndarray]  # by factor: (levels, effects)
    cond: list[np.ndarray]  # by factor: (levels, effects, effects), relative to sigma squared
    a: np.ndarray  # the fixed effects' information after eliminating the random ones
    ld_l2: float
    ld_rx2: float
    r2: float
    u2: float = 0.0  # squared length of the spherical random effects


def split(spec: Spec, theta: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for t in spec.terms:
        out.append(np.asarray(theta[at : at + t.structure.n_par], float))
        at += t.structure.n_par
    return out


def factor_template(spec: Spec, g: Gram, theta: np.ndarray, k: int) -> np.ndarray:
    """The relative Cholesky factor of all terms of factor k, block by block."""
    par = split(spec, theta)
    blocks = [spec.terms[i].structure.factor(par[i]) for i in g.factors[k].terms]
    out = np.zeros((sum(len(b) for b in blocks),) * 2)
    at = 0
    for b in blocks:
        out[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return out


def _fixed(xx, xy, yy, less_xx, less_xy, less_yy):
    a, c = xx - less_xx, xy - less_xy
    beta = np.linalg.solve(a, c) if len(a) else np.zeros(0)
    sign, ld = np.linalg.slogdet(a) if len(a) else (1.0, 0.0)
    return a, beta, float(ld) if sign > 0 else np.inf, yy - less_yy - float(c @ beta)


def _level_sums(t: np.ndarray, zz: np.ndarray, zx: np.ndarray, zy: np.ndarray):
    """Of levels that meet no other random effects: log determinant, what they take from X'X, X'y and y'y, and their solves."""
    m = t.T @ zz @ t + np.eye(len(t))
    ld = 2 * float(np.log(np.diagonal(np.linalg.cholesky(m), axis1=1, axis2=2)).sum())
    tx, ty = t.T @ zx, zy @ t
    sx = np.linalg.solve(m, tx)
    sy = np.linalg.solve(m, ty[..., None])[..., 0]
    return ld, np.einsum("lkp,lkq->pq", tx, sx), np.einsum("lkp,lk->p", tx, sy), float((ty * sy).sum()), m, sx, sy


def _remote(spec: Spec, g: Gram, t: np.ndarray) -> Solution:
    """One evaluation over level sums that stay distributed: each batch sends its part of a few small sums."""
    f, k, p = g.factors[0], len(t), len(g.xx)

    def run(batches):
        total = np.zeros(2 + p * p + p)
        for pdf in batches:
            if len(pdf):
                ld, xx, xy, yy, *_ = _level_sums(t, *unpack(pdf.drop(columns="g").to_numpy(float), k, p))
                total += np.concatenate([[ld, yy], xx.ravel(), xy])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    got = f.table.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas().v.to_numpy()
    a, beta, ld_rx, r2 = _fixed(g.xx, g.xy, g.yy, got[2 : 2 + p * p].reshape(p, p), got[2 + p * p :], got[1])
    return Solution(beta, [], [], a, float(got[0]), ld_rx, r2)


def solve(spec: Spec, g: Gram, theta: np.ndarray, full: bool = True) -> Solution:
    ts = [factor_template(spec, g, theta, k) for k in range(len(g.factors))]
    if not g.factors:
        a, beta, ld_rx, r2 = _fixed(g.xx, g.xy, g.yy, 0, 0, 0.0)
        return Solution(beta, [], [], a, 0.0, ld_rx, r2)
    if g.factors[0].table is not None:
        return _remote(spec, g, ts[0])
    if len(g.factors) == 1:
        f, t = g.factors[0], ts[0]
        ld, xx, xy, yy, m, sx, sy = _level_sums(t, f.zz, f.zx, f.zy)
        a, beta, ld_rx, r2 = _fixed(g.xx, g.xy, g.yy, xx, xy, yy)
        if not full:
            return Solution(beta, [], [], a, ld, ld_rx, r2)
        u = sy - sx @ beta
        return Solution(beta, [u @ t.T], [t @ np.linalg.inv(m) @ t.T], a, ld, ld_rx, r2, float((u * u).sum()))
    return _crossed(spec, g, ts, full)


def _crossed(spec: Spec, g: Gram, ts: list[np.ndarray], full: bool) -> Solution:
    """Several factors: the largest is eliminated level by level, the others meet in one dense matrix."""
    big = int(np.argmax([f.zy.size for f in g.factors]))
    rest = [k for k in range(len(g.factors)) if k != big]
    f0, t0 = g.factors[big], ts[big]
    n0, k0 = f0.zy.shape
    off = dict(zip(rest, np.cumsum([0, *(g.factors[k].zy.size for k in rest)])[:-1].tolist(), strict=True))
    q, p = sum(g.factors[k].zy.size for k in rest), len(g.xx)
    d = np.zeros((q, q))
    rhs = np.zeros((q, p + 1))
    for k in rest:
        f, t = g.factors[k], ts[k]
        n, e = f.zy.shape
        at = off[k] + np.arange(n)[:, None] * e + np.arange(e)
        d[at[:, :, None], at[:, None, :]] = t.T @ f.zz @ t + np.eye(e)
        rhs[at.ravel()] = np.concatenate([t.T @ f.zx, (f.zy @ t)[..., None]], axis=2).reshape(-1, p + 1)
    meets = []  # (level of the largest factor, columns, block)
    for (i, j), (ia, ib, blk) in g.cross.items():
        blk = ts[i].T @ blk @ ts[j]
        if big in (i, j):
            own, other, k, blk = (ia, ib, j, blk) if i == big else (ib, ia, i, np.swapaxes(blk, 1, 2))
            order = np.argsort(own, kind="stable")
            e = g.factors[k].zy.shape[1]
            meets.append((own[order], off[k] + other[order][:, None] * e + np.arange(e), blk[order]))
        else:
            ra = off[i] + ia[:, None] * len(ts[i]) + np.arange(len(ts[i]))
            rb = off[j] + ib[:, None] * len(ts[j]) + np.arange(len(ts[j]))
            d[ra[:, :, None], rb[:, None, :]] = blk
            d[np.swapaxes(rb[:, None, :], 1, 2), np.swapaxes(ra[:, :, None], 1, 2)] = np.swapaxes(blk, 1, 2)
    m0 = t0.T @ f0.zz @ t0 + np.eye(k0)
    l0 = np.linalg.cholesky(m0)
    ld = 2 * float(np.log(np.diagonal(l0, axis1=1, axis2=2)).sum())
    own0 = np.concatenate([t0.T @ f0.zx, (f0.zy @ t0)[..., None]], axis=2)  # (n0, k0, p + 1)
    w0 = np.linalg.solve(m0, own0)

    def rows(a: int, b: int) -> np.ndarray:
        c = np.zeros((b - a, k0, q))
        for lv, cols, blk in meets:
            lo, hi = np.searchsorted(lv, a), np.searchsorted(lv, b)
            c[(lv[lo:hi] - a)[:, None, None], np.arange(k0)[None, :, None], cols[lo:hi][:, None, :]] = blk[lo:hi]
        return c

    for a in range(0, n0, CHUNK):
        b = min(n0, a + CHUNK)
        c = rows(a, b)
        half = np.linalg.solve(l0[a:b], c).reshape(-1, q)
        d -= half.T @ half
        rhs -= c.reshape(-1, q).T @ w0[a:b].reshape(-1, p + 1)
    chol = np.linalg.cholesky(d)
    ld += 2 * float(np.log(np.diag(chol)).sum())
    s = np.linalg.solve(chol.T, np.linalg.solve(chol, rhs))
    less = np.einsum("lkp,lkq->pq", own0, w0) + rhs.T @ s
    a_, beta, ld_rx, r2 = _fixed(g.xx, g.xy, g.yy, less[:p, :p], less[:p, p], float(less[p, p]))
    if not full:
        return Solution(beta, [], [], a_, ld, ld_rx, r2)
    ur = s[:, p] - s[:, :p] @ beta
    inv = np.linalg.inv(d)
    u0 = np.zeros((n0, k0))
    cond0 = np.zeros((n0, k0, k0))
    for a in range(0, n0, CHUNK):
        b = min(n0, a + CHUNK)
        mc = np.linalg.solve(m0[a:b], rows(a, b))
        u0[a:b] = w0[a:b, :, p] - w0[a:b, :, :p] @ beta - mc @ ur
        v = np.linalg.inv(m0[a:b]) + mc @ inv @ np.swapaxes(mc, 1, 2)
        cond0[a:b] = t0 @ v @ t0.T
    bs, conds = [None] * len(g.factors), [None] * len(g.factors)
    bs[big], conds[big] = u0 @ t0.T, cond0
    for k in rest:
        n, e = g.factors[k].zy.shape
        at = off[k] + np.arange(n)[:, None] * e + np.arange(e)
        bs[k] = ur[at] @ ts[k].T
        conds[k] = ts[k] @ inv[at[:, :, None], at[:, None, :]] @ ts[k].T
    return Solution(beta, bs, conds, a_, ld, ld_rx, r2, float((u0 * u0).sum() + (ur * ur).sum()))


def joint(spec: Spec, g: Gram, theta: np.ndarray, most: int = MOST_DENSE) -> tuple[np.ndarray, list[int]]:
    """Covariance of all random effects (factor by factor, level by level) and the fixed effects, relative to sigma squared.

    Dense, so for at most `most` random effects; also where each factor begins.
    """
    sizes = [f.zy.size for f in g.factors]
    q, p = sum(sizes), len(g.xx)
    if q > most:
        raise ValueError(f"the joint covariance takes at most {most} random effects")
    off = np.cumsum([0, *sizes])
    lam, zz, zx = np.zeros((q, q)), np.zeros((q, q)), np.zeros((q, p))
    for k, f in enumerate(g.factors):
        n, e = f.zy.shape
        at = off[k] + np.arange(n)[:, None] * e + np.arange(e)
        zz[at[:, :, None], at[:, None, :]] = f.zz
        lam[at[:, :, None], at[:, None, :]] = factor_template(spec, g, theta, k)
        zx[at.ravel()] = f.zx.reshape(-1, p)
    for (i, j), (ia, ib, blk) in g.cross.items():
        ra = off[i] + ia[:, None] * blk.shape[1] + np.arange(blk.shape[1])
        rb = off[j] + ib[:, None] * blk.shape[2] + np.arange(blk.shape[2])
        zz[ra[:, :, None], rb[:, None, :]] = blk
        zz[rb[:, :, None], ra[:, None, :]] = np.swapaxes(blk, 1, 2)
    big = np.block([[lam.T @ zz @ lam + np.eye(q), lam.T @ zx], [zx.T @ lam, g.xx]])
    inv = np.linalg.inv(big)
    t = np.zeros_like(big)
    t[:q, :q], t[q:, q:] = lam, np.eye(p)
    return t @ inv @ t.T, off.tolist()


def deviance(spec: Spec, g: Gram, theta: np.ndarray, reml: bool, sigma: float | None = None) -> float:
    s = solve(spec, g, theta, full=False)
    p = len(g.xx) if reml else 0
    df = g.n - p
    out = float(s.ld_l2 + (s.ld_rx2 if reml else 0.0) - g.sum_log_w)
    if sigma is not None:
        return float(out + df * (np.log(2 * np.pi) + 2 * np.log(sigma)) + s.r2 / sigma**2)
    return float(out + df * (1 + np.log(2 * np.pi * max(s.r2, 1e-300) / df)))
