"""What deleting a group or a row does to a fit, from sums less the deleted part's own."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.operators import pls
from mixloom.operators.gram import factor_columns, unpack

#: Nodes of theta at which sums over all levels are evaluated once; deletions interpolate between them.
NODES = 24


def _nodes(theta: float) -> np.ndarray:
    """Chebyshev nodes over thetas around the model's own, by the square root scale near zero."""
    lo, hi = (0.0, 0.2) if theta < 0.02 else (theta * 0.5, theta * 1.6)
    k = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    return (lo + hi) / 2 + (hi - lo) / 2 * k


def _weights() -> np.ndarray:
    k = np.arange(NODES)
    return (-1.0) ** k * np.sin(np.pi * (k + 0.5) / NODES)


def _interpolate(nodes: np.ndarray, w: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Barycentric interpolation of each row's values at the nodes, v (rows, nodes, ...), at its x."""
    d = x[:, None] - nodes[None, :]
    hit = np.abs(d) < 1e-14
    c = w[None, :] / np.where(hit, 1.0, d)
    c = np.where(hit.any(axis=1, keepdims=True), hit.astype(float), c)
    return np.einsum("rn,rn...->r...", c / c.sum(axis=1, keepdims=True), v)


def influence(model, by: str = "group") -> DataFrame:
    """deleted, param, value, change, se: fixed effects, theta and sigma after deleting each level of the only grouping factor
    (by group), or each row (by row; deleted is its number in the frame's order of a hash). change is from the full fit.

    Theta is found anew for each deletion. With one scalar effect, sums over all levels are evaluated at NODES thetas once,
    so a deletion costs no pass over the levels; otherwise, or where the optimum leaves the nodes' range, the fit is repeated
    from the downdated sums, in parallel.
    """
    if len(model.gram.factors) != 1:
        raise ValueError("deletions need a single grouping factor")
    if by not in ("group", "row"):
        raise ValueError("by is group or row")
    g, spec, reml = model.gram, model.spec, model.reml
    f = g.factors[0]
    p, k = len(g.xx), f.zz.shape[1]
    zs, xs = factor_columns(spec, f.terms), spec.x_cols
    frame = spec.frame.withColumn("_r", F.col("_y") - F.col("_o")).where("_w > 0")
    own = [(xs[i], xs[j]) for i in range(p) for j in range(i, p)] + [(x, "_r") for x in xs] + [("_r", "_r")]
    level = [(zs[i], zs[j]) for i in range(k) for j in range(i, k)] + [(z, x) for z in zs for x in xs] + [(z, "_r") for z in zs]
    product = lambda a, b: F.col("_w") * F.col(f"`{a}`") * F.col(f"`{b}`")
    grp = F.col(f"`_g_{f.name}`")
    if by == "group":
        units = frame.groupBy(grp.alias("g")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.log("_w")).alias("lw"), F.array(*(F.sum(product(*x)) for x in own)).alias("own"), F.array(*(F.sum(product(*x)) for x in level)).alias("lev")).select(F.col("g").alias("deleted"), "g", "n", "lw", "own", "lev")
    else:
        from mixloom.operators.lmm import row_key

        key = row_key(spec.frame)
        units = frame.select(key.cast("string").alias("deleted"), grp.alias("g"), F.lit(1.0).alias("n"), F.log("_w").alias("lw"), F.array(*(product(*x) for x in own)).alias("own"), F.array(*(product(*x) for x in level)).alias("lev"))
    sums = frame.groupBy(grp.alias("_g")).agg(F.array(*(F.sum(product(*x)) for x in level)).alias("tot"))
    units = units.join(sums, units["g"] == sums["_g"]).select("deleted", "n", "lw", "own", "lev", "tot")
    names = [*spec.x_names, *(f"theta{i}" for i in range(len(model.theta))), "sigma"]
    full = np.array([*model.solution.beta, *model.theta, model.sigma])
    scalar = k == 1 and len(model.theta) == 1
    nodes, w = (_nodes(float(model.theta[0])), _weights()) if scalar else (None, None)
    total = None
    if scalar:
        parts = [pls._level_sums(np.array([[x]]), f.zz, f.zx, f.zy)[:4] for x in nodes]
        total = tuple(np.array([q[i] for q in parts]) for i in range(4))  # ld, xx, xy, yy by node
    thin = replace(spec, frame=None, full=None)
    # levels are sent once; a factor of at most MOST_LEVELS is what a fit holds anyway
    sent = spec.frame.sparkSession.sparkContext.broadcast((g.xx, g.xy, g.yy, g.n, g.sum_log_w, g, model.theta, full, names))

    def sizes(df):
        own = np.stack(df.own.to_list())
        xx = np.zeros((len(df), p, p))
        for c, (i, j) in enumerate((i, j) for i in range(p) for j in range(i, p)):
            xx[:, i, j] = xx[:, j, i] = own[:, c]
        at = p * (p + 1) // 2
        return xx, own[:, at : at + p], own[:, at + p]

    def refit(xx, xy, yy, n, lw, lev, tot, theta, g):
        from mixloom.operators.lmm import fit_gram

        a, b = unpack(tot[None, :], k, p), unpack(lev[None, :], k, p)
        # the deleted unit's level is found by its sums: levels with equal sums are exchangeable
        fac = g.factors[0]
        at = int(np.argmin(np.abs(fac.zy - a[2]).sum(axis=1) + np.abs(fac.zz - a[0]).sum(axis=(1, 2)) + np.abs(fac.zx - a[1]).sum(axis=(1, 2))))
        zz, zx, zy = fac.zz.copy(), fac.zx.copy(), fac.zy.copy()
        zz[at], zx[at], zy[at] = a[0][0] - b[0][0], a[1][0] - b[1][0], a[2][0] - b[2][0]
        down = replace(g, n=g.n - int(n), sum_log_w=g.sum_log_w - lw, xx=g.xx - xx, xy=g.xy - xy, yy=g.yy - yy, factors=[replace(fac, zz=zz, zx=zx, zy=zy)])
        m = fit_gram(thin, down, reml, start=theta, quiet=True)
        return np.array([*m.solution.beta, *m.theta, m.sigma]), np.sqrt(np.diag(m.vcov()))

    def run(batches):
        gxx, gxy, gyy, gn, glw, whole, theta, full, names = sent.value
        for df in batches:
            if not len(df):
                continue
            n, lw = gn - df.n.to_numpy(), glw - df.lw.to_numpy()
            xx, xy, yy = sizes(df)
            out, se = np.full((len(df), len(full)), np.nan), np.full((len(df), len(full)), np.nan)
            again = np.arange(len(df))
            if scalar:
                tot, lev = np.stack(df.tot.to_list()), np.stack(df.lev.to_list())
                (zz, zx, zy), (dz, dx, dy) = unpack(tot, 1, p), unpack(lev, 1, p)
                nz, nx, ny = zz[:, 0, 0] - dz[:, 0, 0], zx[:, 0] - dx[:, 0], zy[:, 0] - dy[:, 0]

                def take(z, x, y, t):  # what a level of sums z, x, y takes at theta t
                    m = 1 + t * t * z
                    s = t * t / m
                    return np.log(m), s[..., None, None] * x[..., :, None] * x[..., None, :], s[..., None] * x * y[..., None], s * y * y

                t = nodes[None, :]
                was = take(zz[:, 0, 0][:, None], zx[:, 0][:, None, :], zy[:, 0][:, None], t)
                now = take(nz[:, None], nx[:, None, :], ny[:, None], t)
                ld, a, c, r = (tt[None] - o + q for tt, o, q in zip(total, was, now, strict=True))
                a, c, r = (gxx - xx)[:, None] - a, (gxy - xy)[:, None] - c, (gyy - yy)[:, None] - r
                beta = np.linalg.solve(a, c[..., None])[..., 0]
                r2 = r - (c * beta).sum(axis=-1)
                df_ = n - (p if reml else 0)
                dev = ld + (np.linalg.slogdet(a)[1] if reml else 0) + df_[:, None] * np.log(np.maximum(r2, 1e-300))
                lo, hi = np.full(len(df), nodes.min()), np.full(len(df), nodes.max())
                gold = (5**0.5 - 1) / 2
                value = lambda x: _interpolate(nodes, w, x, dev)
                x1, x2 = hi - gold * (hi - lo), lo + gold * (hi - lo)
                f1, f2 = value(x1), value(x2)
                for _ in range(45):
                    left = f1 < f2
                    hi, lo = np.where(left, x2, hi), np.where(left, lo, x1)
                    x1, x2 = hi - gold * (hi - lo), lo + gold * (hi - lo)
                    f1, f2 = value(x1), value(x2)
                best = (lo + hi) / 2
                span = nodes.max() - nodes.min()
                edge = (best - nodes.min() < 1e-3 * span) | (nodes.max() - best < 1e-3 * span)
                out[:, :p], out[:, p] = _interpolate(nodes, w, best, beta), best
                s2 = _interpolate(nodes, w, best, r2) / df_
                out[:, p + 1] = np.sqrt(s2)
                inv = np.linalg.inv(np.stack([_interpolate(nodes, w, best, a[:, :, i, j]) for i in range(p) for j in range(p)], axis=-1).reshape(-1, p, p))
                se[:, :p] = np.sqrt(s2[:, None] * np.diagonal(inv, axis1=1, axis2=2))
                again = np.flatnonzero(edge)  # the optimum lies beyond the nodes, or at zero
            for i in again:
                out[i], se[i, :p] = refit(xx[i], xy[i], yy[i], df.n.iloc[i], df.lw.iloc[i], np.asarray(df.lev.iloc[i]), np.asarray(df.tot.iloc[i]), theta, whole)
            m = len(names)
            yield pd.DataFrame({"deleted": np.repeat(df.deleted.to_numpy(), m), "param": names * len(df), "value": out.ravel(), "change": (out - full).ravel(), "se": se.ravel()})

    return units.mapInPandas(run, "deleted string, param string, value double, change double, se double")


def dfbeta(model, by: str = "group") -> DataFrame:
    """deleted, param, dfbeta, dfbetas: changes of the fixed effects, as they are and over their standard errors after deletion."""
    r = influence(model, by).where(F.col("param").isin(*model.spec.x_names))
    return r.select("deleted", "param", F.col("change").alias("dfbeta"), (F.col("change") / F.col("se")).alias("dfbetas"))


def cooks(model, by: str = "group") -> DataFrame:
    """deleted, cooks: the squared change of the fixed effects by their covariance, over their number."""
    p, inv = len(model.solution.beta), np.linalg.inv(model.vcov())
    wide = influence(model, by).where(F.col("param").isin(*model.spec.x_names)).groupBy("deleted").agg(*(F.max(F.when(F.col("param") == n, F.col("change"))).alias(f"c{i}") for i, n in enumerate(model.spec.x_names)))
    return wide.select("deleted", (sum((F.lit(float(inv[i, j])) * F.col(f"c{i}") * F.col(f"c{j}") for i in range(p) for j in range(p)), F.lit(0.0)) / p).alias("cooks"))
