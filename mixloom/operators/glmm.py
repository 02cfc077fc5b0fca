"""Generalized linear mixed models: PIRLS, Laplace and adaptive Gauss-Hermite evaluation on collapsed cells.

Rows that agree in response, weight, offset, effects and groups are one cell with a count: one aggregation collapses the
table, and all iterations run on the cells. That is exact; discrete data shrink by orders of magnitude.

Many cells of one grouping factor stay distributed, all of a level in one part: given theta and the fixed effects each
part finds its modes by itself, and what the driver needs of them are sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.functions import family as fam
from mixloom.functions.family import Family, UserFamily, normal_name
from mixloom.functions.quadrature import gauss_hermite
from mixloom.functions.special import norm_ppf
from mixloom.operators import lmm
from mixloom.operators.gram import MOST_DENSE, factor_columns
from mixloom.operators.optimize import brent, convergence, derivatives, golden, optimize
from mixloom.operators.pls import split
from mixloom.plans.control import Control, glmm_control, report
from mixloom.plans.design import Spec, check, compile_model, normal, rank_check, unit

DEFAULT_LINK = {"binomial": "logit", "poisson": "log", "negative.binomial": "log", "gaussian": "identity", "Gamma": "inverse", "inverse.gaussian": "inverse"}
#: Cells that are taken to the driver at most; those of one part if they stay distributed.
MOST_CELLS, PART = 1_000_000, 20_000


@dataclass
class Cells:
    """Distinct rows with their counts. Effects of all factors stand side by side: z (cells, K) and the place of each among
    the random effects (cells, K), factor by factor and level by level."""

    y: np.ndarray
    w: np.ndarray
    o: np.ndarray
    times: np.ndarray
    x: np.ndarray
    z: np.ndarray
    at: np.ndarray
    levels: list[list[str]]  # by factor
    sizes: list[int]  # effects of a level, by factor
    factors: list[list[int]]  # terms, by factor

    @property
    def p(self) -> int:
        return self.x.shape[1]

    @property
    def q(self) -> int:
        return sum(len(lv) * e for lv, e in zip(self.levels, self.sizes, strict=True))

    def begins(self) -> np.ndarray:
        return np.cumsum([0, *(len(lv) * e for lv, e in zip(self.levels, self.sizes, strict=True))])


@dataclass
class Shards:
    """Cells of one grouping factor that stay distributed, all of a level in one row of table (pickled Cells)."""

    table: DataFrame
    sizes: list[int]
    factors: list[list[int]]
    n: int  # rows of the data
    n_levels: int
    p: int
    keep: list[int] | None = None
    q = 0  # random effects on the driver

    def parts(self, f: Callable, schema: str, pack: Callable) -> DataFrame:
        """pack(f(cells)), a record batch, of each part."""
        keep = self.keep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("cells").to_pylist():
                    c = pickle.loads(x)  # noqa: S301  packed by this process
                    yield pack(f(c if keep is None else replace(c, x=c.x[:, keep])))

        return self.table.mapInArrow(run, schema)

    def sums(self, f: Callable) -> list:
        """Sums over the parts of the arrays in the list that f gives for one."""
        got = self.parts(f, "v binary", lambda v: pa.RecordBatch.from_pydict({"v": [pickle.dumps(v)]})).collect()
        return [sum(x) for x in zip(*(pickle.loads(r.v) for r in got), strict=True)]  # noqa: S301

    def state(self, f: Family, ts: list[np.ndarray], beta: np.ndarray) -> dict:
        """Sums at the modes for beta; without a number among them if some part has none."""

        def own(c: Cells) -> list:
            try:
                u = pirls(c, f, ts, beta, np.zeros(c.q), False)[1]
                zt = _spherical(c, ts)
                mu, d, w = _weights(c, f, _eta(c, zt, beta, u))
                s = System(c, w, zt)
            except (np.linalg.LinAlgError, FloatingPointError):
                return [np.nan] * len(names)
            r = w * (c.y - mu) / d
            dev = (c.times * f.dev_resid(c.y, mu, c.w)).sum()
            pearson = (c.times * c.w * (c.y - mu) ** 2 / f.variance(mu)).sum()
            return [dev, u @ u, s.logdet(), s.a, c.x.T @ r - s.zx.T @ s.solve(s.gather(r) - u), pearson, (c.times * c.w).sum(), f.aic_sums(c.y, mu, c.w, c.times)]

        names = ("dev", "uu", "logdet", "a", "rhs", "pearson", "weight", "aic")
        return dict(zip(names, self.sums(own), strict=True))

    def laplace(self, f: Family, ts: list[np.ndarray], beta: np.ndarray, move_beta: bool, tol: float, most: int) -> tuple[float, np.ndarray]:
        """-2 log likelihood, and beta, moved by the curvature of the penalised deviance at the modes if asked."""
        s = self.state(f, ts, beta)
        now = float(s["dev"] + s["uu"])
        if not np.isfinite(now):
            raise FloatingPointError("the deviance is not a number at the start")
        for _ in range(most if move_beta and len(beta) else 0):
            db, step = np.linalg.solve(s["a"], s["rhs"]), 1.0
            if np.abs(db).max() <= 1e-9 * (1e-3 + np.abs(beta).max()):
                break
            for _ in range(30):
                t = self.state(f, ts, beta + step * db)
                new = float(t["dev"] + t["uu"])
                if np.isfinite(new) and new <= now + 1e-12 * abs(now):
                    break
                step /= 2
            else:
                break
            beta, s, done = beta + step * db, t, abs(now - new) <= tol * (abs(new) + tol)
            now = new
            if done:
                break
        return f.aic_of(s["aic"]) + float(s["uu"] + s["logdet"]), beta

    def modes(self, f: Family, ts: list[np.ndarray], beta: np.ndarray) -> DataFrame:
        """(_lv, _b, _sd): each level's modes and their standard deviations for a scale of 1."""

        def own(c: Cells):
            u = pirls(c, f, ts, beta, np.zeros(c.q), False)[1]
            zt = _spherical(c, ts)
            s = System(c, _weights(c, f, _eta(c, zt, beta, u))[2], zt)
            return c.levels[0], u.reshape(-1, len(ts[0])) @ ts[0].T, np.sqrt(np.maximum(0, np.diagonal(s.blocks(ts)[0], axis1=1, axis2=2)))

        return self.parts(own, "_lv string, _b array<double>, _sd array<double>", lambda v: pa.RecordBatch.from_pydict({"_lv": pa.array(v[0], pa.string()), "_b": pa.array(v[1].tolist(), pa.list_(pa.float64())), "_sd": pa.array(v[2].tolist(), pa.list_(pa.float64()))}))


def _as_cells(t: pd.DataFrame, x_cols: list[str], zs: list[list[str]], factors: list[list[int]]) -> Cells:
    t = t.sort_values(list(t.columns))
    num = lambda c: t[c].to_numpy(float)
    flat = [c for z in zs for c in z]
    levels, at, off = [], [], 0
    for k, z in enumerate(zs):
        lv = sorted(t[f"_lv{k}"].unique())
        levels.append(lv)
        at.append(off + pd.Index(lv).get_indexer(t[f"_lv{k}"])[:, None] * len(z) + np.arange(len(z)))
        off += len(lv) * len(z)
    return Cells(num("_y"), num("_w"), num("_o"), num("_times"), t[x_cols].to_numpy(float).reshape(len(t), -1), t[flat].to_numpy(float).reshape(len(t), -1), np.concatenate(at, axis=1), levels, [len(z) for z in zs], factors)


def collapse(spec: Spec, most: int | None = None) -> Cells | Shards:
    most = MOST_CELLS if most is None else most
    groups = spec.groups
    zs = [[c for t in spec.terms if t.group == g for c in t.columns] for g in groups]
    factors = [[i for i, x in enumerate(spec.terms) if x.group == g] for g in groups]
    flat = [c for z in zs for c in z]
    cells = spec.frame.where("_w > 0").groupBy("_y", "_w", "_o", *spec.x_cols, *flat, *(F.col(f"`_g_{g}`").alias(f"_lv{k}") for k, g in enumerate(groups))).agg(F.count(F.lit(1)).alias("_times"))
    if spec.n > most:
        cells = cells.persist(StorageLevel.DISK_ONLY)
    n = cells.count() if spec.n > most else 0
    if n > most and len(groups) > 1:
        cells.unpersist()
        raise ValueError(f"more than {most} distinct cells of several grouping factors: coarsen continuous covariates")
    if n > most:
        x_cols = list(spec.x_cols)

        def pack(part: pa.Table) -> pa.Table:
            t = part.drop_columns(["_part"]).to_pandas()
            return pa.table({"cells": pa.array([pickle.dumps(_as_cells(t, x_cols, zs, factors))], pa.binary()), "n": [int(t["_times"].sum())], "levels": [t["_lv0"].nunique()]})

        packed = cells.withColumn("_part", F.pmod(F.xxhash64("_lv0"), F.lit(-(-n // PART)))).groupBy("_part").applyInArrow(pack, "cells binary, n bigint, levels bigint").persist(StorageLevel.DISK_ONLY)
        seen = packed.agg(F.sum("n"), F.sum("levels")).first()
        cells.unpersist()
        return Shards(packed.select("cells"), [len(z) for z in zs], factors, int(seen[0]), int(seen[1]), len(x_cols))
    c = _as_cells(cells.toPandas(), spec.x_cols, zs, factors)
    if spec.n > most:
        cells.unpersist()
    if c.q - max(len(lv) * len(z) for lv, z in zip(c.levels, zs, strict=True)) > MOST_DENSE:
        raise ValueError(f"crossed factors with more than {MOST_DENSE} random effects beside the largest factor's")
    return c


def _templates(spec: Spec, c: Cells, theta: np.ndarray) -> list[np.ndarray]:
    """The relative factor of each grouping factor's terms."""
    par = split(spec, theta)
    out = []
    for terms, e in zip(c.factors, c.sizes, strict=True):
        m, at = np.zeros((e, e)), 0
        for i in terms:
            b = spec.terms[i].structure.factor(par[i])
            m[at : at + len(b), at : at + len(b)] = b
            at += len(b)
        out.append(m)
    return out


def _spherical(c: Cells, ts: list[np.ndarray]) -> np.ndarray:
    """Effects' columns for spherical random effects."""
    out, k = np.empty_like(c.z), 0
    for t in ts:
        out[:, k : k + len(t)] = c.z[:, k : k + len(t)] @ t
        k += len(t)
    return out


def _summed(at: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Sums of v (n, ...) by place, in an array (size, ...)."""
    flat = v.reshape(len(v), int(np.prod(v.shape[1:])))
    out = np.empty((size, flat.shape[1]))
    for k in range(flat.shape[1]):
        out[:, k] = np.bincount(at, flat[:, k], size)
    return out.reshape(size, *v.shape[1:])


class System:
    """X'WX, Z'WX and Z'WZ + I of a step, with the random effects' part factorised: by level for the largest factor, and dense
    for what the others are given that one."""

    #: Numbers of the cross products with the largest factor that are held at a time.
    HELD = 4_000_000

    def __init__(self, c: Cells, w: np.ndarray, zt: np.ndarray):
        self.c, self.zt, self.w, p = c, zt, w, c.x.shape[1]
        self.single = len(c.levels) == 1
        ends = np.cumsum([0, *c.sizes])
        k = int(np.argmax(np.diff(c.begins())))
        self.own, self.others = np.arange(ends[k], ends[k + 1]), np.r_[0 : ends[k], ends[k + 1] : ends[-1]]
        e, self.first, n = c.sizes[k], int(c.begins()[k]), len(c.levels[k])
        self.level = (c.at[:, self.own[0]] - self.first) // e
        self.span = slice(self.first, self.first + n * e)
        self.zx = sum(_summed(c.at[:, j], (w * zt[:, j])[:, None] * c.x, c.q) for j in range(zt.shape[1]))
        big = zt[:, self.own]
        self.m = np.eye(e) + _summed(self.level, (w[:, None] * big)[:, :, None] * big[:, None, :], n)
        self.chol = np.linalg.cholesky(self.m)
        if not self.single:
            at = c.at[:, self.others]
            self.place = np.where(at >= self.span.stop, at - n * e, at)  # among the others' effects
            self.rest = c.q - n * e
            z = zt[:, self.others]
            self.s = np.eye(self.rest)
            np.add.at(self.s, (self.place[:, :, None], self.place[:, None, :]), w[:, None, None] * z[:, :, None] * z[:, None, :])
            for _, m, cross in self._crossed():
                self.s -= np.einsum("ler,les->rs", cross, np.linalg.solve(m, cross), optimize=True)
            self.s_chol = np.linalg.cholesky(self.s)
        self.xx = (c.x * w[:, None]).T @ c.x
        self.sx = self.solve(self.zx)
        self.a = self.xx - self.zx.T @ self.sx

    def _crossed(self):
        """For some levels of the largest factor at a time: which, their blocks, their cross products with the others' effects."""
        e = self.m.shape[1]
        order = np.argsort(self.level, kind="stable")
        sorted_level, many = self.level[order], max(1, self.HELD // max(1, e * self.rest))
        for a in range(0, len(self.m), many):
            b = min(a + many, len(self.m))
            at = order[np.searchsorted(sorted_level, a) : np.searchsorted(sorted_level, b)]
            cross = np.zeros((b - a) * e * self.rest)
            for i, j in enumerate(self.own):
                for k, o in enumerate(self.others):
                    cross += np.bincount(((self.level[at] - a) * e + i) * self.rest + self.place[at, k], self.w[at] * self.zt[at, j] * self.zt[at, o], len(cross))
            yield slice(a, b), self.m[a:b], cross.reshape(b - a, e, self.rest)

    def _by_level(self, r: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.m, r.reshape(*self.m.shape[:2], int(np.prod(r.shape[1:])))).reshape(r.shape)

    def _seen(self, v: np.ndarray, at: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """W Z v by cell for the effects in cols, whose values v are found at."""
        return self.w[:, None] * sum(self.zt[:, j, None] * v[at[:, i]] for i, j in enumerate(cols))

    def solve(self, r: np.ndarray) -> np.ndarray:
        if self.single:
            return self._by_level(r)
        flat = r.reshape(len(r), int(np.prod(r.shape[1:])))
        big, rest = flat[self.span], np.delete(flat, self.span, axis=0)
        e, places = self.m.shape[1], self.c.at[:, self.own] - self.first
        seen = self._seen(self._by_level(big), places, self.own)
        rest = rest - sum(_summed(self.place[:, k], self.zt[:, o, None] * seen, self.rest) for k, o in enumerate(self.others))
        rest = np.linalg.solve(self.s_chol.T, np.linalg.solve(self.s_chol, rest))
        seen = self._seen(rest, self.place, self.others)
        big = self._by_level(big - sum(_summed(places[:, i], self.zt[:, j, None] * seen, len(self.m) * e) for i, j in enumerate(self.own)))
        return np.concatenate([rest[: self.first], big, rest[self.first :]]).reshape(r.shape)

    def logdet(self) -> float:
        chols = [self.chol] if self.single else [self.chol, self.s_chol]
        return 2 * float(sum(np.log(np.diagonal(x, axis1=-2, axis2=-1)).sum() for x in chols))

    def gather(self, v: np.ndarray) -> np.ndarray:
        """Z'v."""
        return sum(np.bincount(self.c.at[:, j], v * self.zt[:, j], self.c.q) for j in range(self.zt.shape[1]))

    def blocks(self, ts: list[np.ndarray]) -> list[np.ndarray]:
        """Conditional covariances of each level's effects, by factor, given the fixed effects."""
        if self.single:
            return [ts[0] @ np.linalg.inv(self.m) @ ts[0].T]
        inv, out = np.linalg.inv(self.s), []
        for k, b in enumerate(self.c.begins()[:-1]):
            e = self.c.sizes[k]
            if b == self.first:
                own = np.linalg.inv(self.m)
                for at, m, cross in self._crossed():
                    g = np.linalg.solve(m, cross)
                    own[at] += g @ inv @ g.transpose(0, 2, 1)
                out.append(ts[k] @ own @ ts[k].T)
                continue
            at = b - (self.span.stop - self.first) * (b > self.first) + np.arange(len(self.c.levels[k]))[:, None] * e + np.arange(e)
            out.append(ts[k] @ inv[at[:, :, None], at[:, None, :]] @ ts[k].T)
        return out


def _eta(c: Cells, zt: np.ndarray, beta: np.ndarray, u: np.ndarray) -> np.ndarray:
    return c.o + c.x @ beta + (zt * u[c.at]).sum(axis=1)


def _weights(c: Cells, f: Family, eta: np.ndarray):
    mu, d = f.inverse(eta), f.slope(eta)
    return mu, d, c.times * c.w * d * d / f.variance(mu)


def pirls(c: Cells, f: Family, ts: list[np.ndarray], beta: np.ndarray, u: np.ndarray, move_beta: bool, tol: float = 1e-10, most: int = 100):
    """Penalised iteratively reweighted least squares with step halving; moves u, and beta if asked.

    Returns beta, u and the penalised deviance. It is an error if that is not a number or doesn't settle.
    """
    zt = _spherical(c, ts)

    def pdev(beta, u):
        with np.errstate(all="ignore"):
            return float((c.times * f.dev_resid(c.y, f.inverse(_eta(c, zt, beta, u)), c.w)).sum() + (u * u).sum())

    now = pdev(beta, u)
    if not np.isfinite(now):
        raise FloatingPointError("the deviance is not a number at the start")
    for _ in range(most):
        eta = _eta(c, zt, beta, u)
        mu, d, w = _weights(c, f, eta)
        s = System(c, w, zt)
        r = w * (c.y - mu) / d
        gu = s.gather(r) - u
        if move_beta and len(beta):
            su = s.solve(gu)
            db = np.linalg.solve(s.a, c.x.T @ r - s.zx.T @ su)
            du = su - s.sx @ db
        else:
            db, du = np.zeros_like(beta), s.solve(gu)
        step = 1.0
        for _ in range(30):
            new = pdev(beta + step * db, u + step * du)
            if np.isfinite(new) and new <= now + 1e-12 * abs(now):
                break
            step /= 2
        else:
            break
        beta, u = beta + step * db, u + step * du
        done = abs(now - new) <= tol * (abs(new) + tol)
        now = new
        if done:
            break
    return beta, u, now


def laplace(c: Cells, f: Family, ts: list[np.ndarray], beta: np.ndarray, u: np.ndarray, move_beta: bool, n_agq: int = 1, tol: float = 1e-10, most: int = 100):
    """-2 log likelihood at theta (and beta, unless PIRLS moves it); with more nodes, quadrature around each mode."""
    if isinstance(c, Shards):
        if n_agq > 1:
            raise ValueError(f"more than one quadrature node needs at most {MOST_CELLS} cells")
        return *c.laplace(f, ts, beta, move_beta, tol, most), u
    beta, u, _ = pirls(c, f, ts, beta, u, move_beta, tol, most)
    zt = _spherical(c, ts)
    eta = _eta(c, zt, beta, u)
    mu, _, w = _weights(c, f, eta)
    s = System(c, w, zt)
    if n_agq <= 1:
        return f.aic(c.y, mu, c.w, c.times) + float(u @ u) + s.logdet(), beta, u
    if not s.single or c.sizes[0] != 1:
        raise ValueError("more than one quadrature node needs a single scalar term")
    sd, q = 1 / np.sqrt(s.m[:, 0, 0]), c.q

    def by_level(v):
        out = v * v
        np.add.at(out, c.at[:, 0], f.minus2loglik(c.y, f.inverse(c.o + c.x @ beta + zt[:, 0] * v[c.at[:, 0]]), c.w, c.times))
        return out

    at_mode, total = by_level(u), np.zeros(q)
    for z, wt, _ in gauss_hermite(n_agq):
        total += wt * np.exp(-0.5 * (by_level(u + z * sd) - at_mode) + 0.5 * z * z)
    return float((at_mode - 2 * np.log(total * sd)).sum()), beta, u


@dataclass
class GLMM:
    spec: Spec
    family: Family
    theta: np.ndarray
    beta: np.ndarray
    u: np.ndarray
    deviance: float  # -2 log likelihood
    cells: Cells
    n_agq: int
    hessian: np.ndarray | None = None
    messages: list[str] = field(default_factory=list)
    call: lmm.Call | None = None
    control: Control = field(default_factory=glmm_control)

    is_lmm, is_glmm, is_nlmm, is_reml, reml = False, True, False, False, False

    @property
    def spark(self):
        return self.spec.frame.sparkSession

    @property
    def n(self) -> int:
        return self.cells.n if isinstance(self.cells, Shards) else int(self.cells.times.sum())

    @property
    def n_groups(self) -> dict[str, int]:
        if isinstance(self.cells, Shards):
            return {self.spec.groups[0]: self.cells.n_levels}
        return {g: len(lv) for g, lv in zip(self.spec.groups, self.cells.levels, strict=True)}

    @property
    def npar(self) -> int:
        return len(self.beta) + len(self.theta) + (self.family.name == "negative.binomial") + self.family.has_scale

    @property
    def df_residual(self) -> int:
        return self.n - self.npar

    def log_lik(self, reml: bool | None = None) -> float:
        return -self.deviance / 2

    def aic(self) -> float:
        return self.deviance + 2 * self.npar

    def bic(self) -> float:
        return float(self.deviance + np.log(self.n) * self.npar)

    def refit_ml(self) -> GLMM:
        return self

    def fixef(self, add_dropped: bool = False) -> dict[str, float]:
        return dict(zip(self.spec.x_names, self.beta.tolist(), strict=True)) | (dict.fromkeys(self.spec.dropped, float("nan")) if add_dropped else {})

    def _sums(self) -> dict:
        """The sums of cells that stay distributed."""
        return self.cells.state(self.family, _templates(self.spec, self.cells, self.theta), self.beta)

    def _state(self):
        if isinstance(self.cells, Shards):
            raise ValueError(f"this needs at most {MOST_CELLS} distinct cells")
        ts = _templates(self.spec, self.cells, self.theta)
        zt = _spherical(self.cells, ts)
        eta = _eta(self.cells, zt, self.beta, self.u)
        mu, d, w = _weights(self.cells, self.family, eta)
        return ts, eta, mu, d, System(self.cells, w, zt)

    def residual_deviance(self) -> float:
        """The deviance of the response given the modes."""
        if isinstance(self.cells, Shards):
            return float(self._sums()["dev"])
        c, (_, _, mu, _, _) = self.cells, self._state()
        return float((c.times * self.family.dev_resid(c.y, mu, c.w)).sum())

    @property
    def sigma(self) -> float:
        """1 without a scale; else the root of the mean penalised deviance."""
        if not self.family.has_scale:
            return 1.0
        if isinstance(self.cells, Shards):
            s = self._sums()
            return float(np.sqrt((s["pearson"] + s["uu"]) / self.n))
        c, (_, _, mu, _, _) = self.cells, self._state()
        pearson = float((c.times * c.w * (c.y - mu) ** 2 / self.family.variance(mu)).sum())
        return float(np.sqrt((pearson + self.u @ self.u) / self.n))

    def gamma_shape(self) -> float:
        """The gamma's shape from the mean deviance D: (6 + 2 D) / (D (6 + D))."""
        if isinstance(self.cells, Shards):
            s = self._sums()
            d = float(s["dev"] / s["weight"])
        else:
            d = self.residual_deviance() / float((self.cells.times * self.cells.w).sum())
        return (6 + 2 * d) / (d * (6 + d))

    def vcov(self, correlation: bool = False, use_hessian: bool | None = None) -> np.ndarray:
        """From the Hessian over theta and the fixed effects if there is one that is positive definite, else given theta."""
        h = self.hessian
        v = None
        if h is not None and use_hessian is not False:
            k = len(self.theta)
            try:
                np.linalg.cholesky(h)
                v = 2 * np.linalg.inv(h)[k:, k:]
            except np.linalg.LinAlgError:
                if use_hessian:
                    raise ValueError("the Hessian is not positive definite") from None
        if v is None:
            v = self.sigma**2 * np.linalg.inv(self._sums()["a"] if isinstance(self.cells, Shards) else self._state()[4].a)
        return v / np.sqrt(np.outer(np.diag(v), np.diag(v))) if correlation else v

    def var_corr(self):
        out = []
        for t, p in zip(self.spec.terms, split(self.spec, self.theta), strict=True):
            m = t.structure.factor(p)
            out.append((t.group, t.names, self.sigma**2 * m @ m.T))
        return out

    def var_corr_df(self, order: str = "cov.last") -> DataFrame:
        rows = [r for g, names, v in self.var_corr() for r in lmm.cov_rows(g, names, v, order)]
        rows += [("Residual", None, None, self.sigma**2, self.sigma)] if self.family.has_scale else []
        return self.spark.createDataFrame(rows, "grp string, var1 string, var2 string, vcov double, sdcor double")

    def is_singular(self, tol: float = 1e-4) -> bool:
        return any(t.structure.singular(p, tol) for t, p in zip(self.spec.terms, split(self.spec, self.theta), strict=True))

    def coef_table(self) -> DataFrame:
        s = self.summary()
        return self.spark.createDataFrame(s.coefficients, "term string, estimate double, std_error double, z_value double, p_value double")

    def modes(self) -> list[tuple[str, list[str], np.ndarray, np.ndarray]]:
        """By factor: its name, effects, modes (levels, effects) and their standard deviations."""
        ts, _, _, _, s = self._state()
        out = []
        for k, (g, t, cond) in enumerate(zip(self.spec.groups, ts, s.blocks(ts), strict=True)):
            b = self.cells.begins()
            u = self.u[b[k] : b[k + 1]].reshape(-1, len(t))
            names = [n for i in self.cells.factors[k] for n in self.spec.terms[i].names]
            out.append((g, names, u @ t.T, self.sigma * np.sqrt(np.maximum(0, np.diagonal(cond, axis1=1, axis2=2)))))
        return out

    def ranef(self) -> DataFrame:
        if isinstance(self.cells, Shards):
            names = [n for t in self.spec.terms for n in t.names]
            t = self.cells.modes(self.family, _templates(self.spec, self.cells, self.theta), self.beta)
            return t.select(F.lit(self.spec.groups[0]).alias("grpvar"), F.col("_lv").alias("grp"), F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("n"), "_b", "_sd")).alias("x")).select("grpvar", F.col("x.n").alias("term"), "grp", F.col("x._b").alias("condval"), (F.lit(self.sigma) * F.col("x._sd")).alias("condsd"))
        rows = [(g, n, lv, float(b[i, j]), float(sd[i, j])) for k, (g, names, b, sd) in enumerate(self.modes()) for i, lv in enumerate(self.cells.levels[k]) for j, n in enumerate(names)]
        return self.spark.createDataFrame(rows, "grpvar string, term string, grp string, condval double, condsd double")

    def coef(self) -> DataFrame:
        """Fixed effects plus modes of the first factor by level."""
        g, names, b, _ = self.modes()[0]
        fixed = self.fixef()
        rows = [(lv, n, float(fixed.get(n, 0.0) + (b[i, names.index(n)] if n in names else 0.0))) for i, lv in enumerate(self.cells.levels[0]) for n in dict.fromkeys([*fixed, *names])]
        return self.spark.createDataFrame(rows, "grp string, term string, value double")

    # -- rows ------------------------------------------------------------------------------------
    def _linear(self, frame: DataFrame, re_form="all", allow_new: bool = True) -> DataFrame:
        """frame with _eta, the linear predictor with offset."""
        eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(self.beta, self.spec.x_cols, strict=True)), F.col("_o"))
        out = frame
        sharded = isinstance(self.cells, Shards)
        for k, (g, _, b, _) in enumerate([(self.spec.groups[0], None, None, None)] if sharded else self.modes()):
            if re_form is None or re_form != "all" and g not in ([re_form] if isinstance(re_form, str) else re_form):
                continue
            if sharded:
                table = self.cells.modes(self.family, _templates(self.spec, self.cells, self.theta), self.beta).select(F.col("_lv").alias("_lv0"), F.col("_b").alias("_b0"))
            else:
                table = self.spark.createDataFrame([(lv, b[i].tolist()) for i, lv in enumerate(self.cells.levels[k])], f"_lv{k} string, _b{k} array<double>")
            out = out.join(F.broadcast(table) if not sharded and b.size < 500_000 else table, out[f"`_g_{g}`"] == table[f"_lv{k}"], "left")
            if not allow_new:
                new = out.where(f"_lv{k} is null and `_g_{g}` is not null").select(f"`_g_{g}`").distinct().limit(6).collect()
                if new:
                    raise ValueError(f"new levels in {g}: {', '.join(sorted(r[0] for r in new))[:60]}")
            own = sum((F.col(z) * F.coalesce(F.col(f"_b{k}")[j], F.lit(0.0)) for j, z in enumerate(factor_columns(self.spec, self.cells.factors[k]))), F.lit(0.0))
            eta = eta + F.when(F.col(f"`_g_{g}`").isNotNull(), own)
        return out.withColumn("_eta", eta).drop(*(c for k in range(len(self.spec.groups)) for c in (f"_lv{k}", f"_b{k}")))

    def _mean(self, eta: Column) -> Column:
        if isinstance(self.family, UserFamily):
            f = self.family
            return F.pandas_udf(lambda x: pd.Series(f.inverse(x.to_numpy(float))), "double")(eta)
        return fam.link_inverse(self.family.link, eta)

    def fitted(self) -> DataFrame:
        """The rows of the fit with eta and fitted (the mean)."""
        return self._linear(self.spec.frame).withColumn("eta", F.col("_eta")).withColumn("fitted", self._mean(F.col("_eta"))).drop("_eta")

    def residuals(self, kind: str = "deviance") -> DataFrame:
        """fitted() with residual: deviance (signed root), pearson, working or response."""
        out, f = self.fitted(), self.family
        mu, y, w = F.col("fitted"), F.col("_y"), F.col("_w")
        kinds = {
            "deviance": lambda: F.signum(y - mu) * F.sqrt(F.greatest(F.lit(0.0), fam.dev_resid(f.name, y, mu, w, f.theta))),
            "pearson": lambda: (y - mu) * F.sqrt(w / fam.variance(f.name, mu, f.theta)),
            "working": lambda: (y - mu) / fam.mu_eta(f.link, F.col("eta")),
            "response": lambda: y - mu,
        }
        if kind not in kinds:
            raise ValueError(f"no residuals of type {kind!r}")
        return out.withColumn("residual", kinds[kind]())

    def _quadratic(self, rows: DataFrame, modes: bool = True) -> DataFrame:
        """rows with _quad, the relative variance of the linear predictor given theta; of the fixed part alone without modes.

        A level that the fit has not seen has no variance of its own.
        """
        ts, _, _, _, s = self._state()
        q, p = self.cells.q, len(self.beta)
        ainv = np.linalg.inv(s.a)
        d = [F.col(c) for c in self.spec.x_cols]
        quad, out, group = F.lit(0.0), rows, None
        if modes:
            if not s.single:
                raise ValueError("these variances of generalized models need a single grouping factor")
            inv, e, t = np.linalg.inv(s.m), self.cells.sizes[0], ts[0]
            k = t @ inv @ t.T
            sx = (t @ s.sx.reshape(q // e, e, p)).transpose(0, 2, 1)
            table = self.spark.createDataFrame([(lv, k[i].ravel().tolist(), sx[i].ravel().tolist()) for i, lv in enumerate(self.cells.levels[0])], "_lv string, _k array<double>, _s array<double>")
            group = F.col(f"`_g_{self.spec.groups[0]}`")
            out = rows.join(table, group == table["_lv"], "left")
            z = [F.col(c) for c in factor_columns(self.spec, self.cells.factors[0])]
            quad = sum((z[a] * z[b] * F.coalesce(F.col("_k")[a * e + b], F.lit(0.0)) for a in range(e) for b in range(e)), quad)
            d = [x - sum((F.coalesce(F.col("_s")[i * e + a], F.lit(0.0)) * z[a] for a in range(e)), F.lit(0.0)) for i, x in enumerate(d)]
        quad = quad + sum((F.lit(float(ainv[i, j])) * d[i] * d[j] for i in range(p) for j in range(p)), F.lit(0.0))
        return out.withColumn("_quad", quad if group is None else F.when(group.isNotNull(), quad)).drop("_lv", "_k", "_s")

    def hat(self) -> DataFrame:
        """residuals("pearson") with hat, rstandard and cooks; hat is the working weight times the row's relative variance."""
        out = self._quadratic(self.residuals("pearson"))
        f, me = self.family, fam.mu_eta(self.family.link, F.col("eta"))
        out = out.withColumn("hat", F.col("_w") * me * me / fam.variance(f.name, F.col("fitted"), f.theta) * F.col("_quad")).drop("_quad")
        scale = F.lit(self.sigma)
        out = out.withColumn("rstandard", F.col("residual") / (scale * F.sqrt(1 - F.col("hat"))))
        return out.withColumn("cooks", F.pow(F.col("residual") / (scale * (1 - F.col("hat"))), 2) * F.col("hat") / len(self.beta))

    def predict(self, newdata: DataFrame | None = None, re_form="all", kind: str = "link", allow_new: bool = False, se_fit: bool = False) -> DataFrame:
        """newdata with pred, on the scale of the link or of the response. Levels, nulls and groups as for linear models.

        se_fit adds se: given theta, by the joint curvature at the modes; on the response's scale times the slope of the mean.
        """
        newdata = newdata if newdata is not None else self.call.data
        out = self._linear(lmm.LMM._new_frame(self, newdata), re_form, allow_new)
        if se_fit:
            slope = F.lit(1.0)
            if kind == "response":
                if isinstance(self.family, UserFamily):
                    raise ValueError("standard errors of a user family's means are not known; take those of the link")
                slope = F.abs(fam.mu_eta(self.family.link, F.col("_eta")))
            out = self._quadratic(out, re_form is not None).withColumn("se", F.lit(self.sigma) * F.sqrt("_quad") * slope)
        pred = self._mean(F.col("_eta")) if kind == "response" else F.col("_eta")
        return out.withColumn("pred", pred).select(*(F.col(f"`{c}`") for c in newdata.columns if c not in ("pred", "se") or c == "se" and not se_fit), "pred", *(["se"] if se_fit else []))

    def simulate(self, nsim: int = 1, seed: int = 1, use_u: bool = False, newdata: DataFrame | None = None) -> DataFrame:
        """The rows nsim times with sim, drawn from the family around new modes, or around the fitted ones with use_u."""
        frame = (self.spec.frame if newdata is None else lmm.LMM._new_frame(self, newdata)).drop("sim", "sim_id")
        sims = frame.withColumn("_row", lmm.row_key(frame)).select("*", F.explode(F.sequence(F.lit(1), F.lit(nsim))).alias("sim_id"))
        out = self._linear(sims, "all" if use_u else None)
        if not use_u:
            out = out.withColumn("_eta", F.col("_eta") + drawn_effects(self.spec, self.theta, self.sigma, seed))
        out = out.withColumn("_mu", self._mean(F.col("_eta")))
        return out.withColumn("sim", draw(self.family, F.col("_mu"), F.col("_w"), self.sigma, seed))

    def summary(self):
        from mixloom.operators.summary import summarize

        return summarize(self)

    def __str__(self) -> str:
        return str(self.summary())

    def confint(self, level: float = 0.95) -> DataFrame:
        z, se = norm_ppf(0.5 + level / 2), np.sqrt(np.diag(self.vcov()))
        return self.spark.createDataFrame([(n, float(b - z * s), float(b + z * s)) for n, b, s in zip(self.spec.x_names, self.beta, se, strict=True)], "term string, lower double, upper double")

    def refit(self, response: str) -> GLMM:
        """The same model for another response."""
        frame = self.spec.frame.withColumn("_y", F.expr(response).cast("double"))
        return fit_cells(replace(self.spec, frame=frame), self.family, collapse(replace(self.spec, frame=frame)), self.n_agq, self.control, start=(self.theta, self.beta))

    def _spread_limits(self, k: int, z: float) -> tuple[float, float]:
        """Where the root of the deviance's rise is z, with theta[k] held; 0 if it is less there."""
        low, up = lmm.bounds(self.spec)
        nt, free = len(low), len(self.beta)
        keep = [i for i in range(nt) if i != k]
        state = [np.concatenate([self.theta[keep], self.beta])]

        def zeta(v: float) -> float:
            def f(par):
                theta = np.insert(par[: nt - 1], k, v)
                try:
                    return laplace(self.cells, self.family, _templates(self.spec, self.cells, theta), par[nt - 1 :], np.zeros(self.cells.q), False, self.n_agq)[0]
                except (np.linalg.LinAlgError, FloatingPointError):
                    return np.inf

            if not len(state[0]):
                return float(np.sqrt(max(0.0, f(state[0]) - self.deviance)))
            o = optimize(f, state[0], np.concatenate([low[keep], np.full(free, -np.inf)]), np.concatenate([up[keep], np.full(free, np.inf)]), "quadratic", {"radius": 0.05, "least": 1e-5}, restart_edge=False)
            state[0] = o.par
            return float(np.sqrt(max(0.0, o.value - self.deviance)))

        def between(a: float, za: float, b: float, zb: float) -> float:
            """Secant steps held inside the bracket; za <= z <= zb."""
            for _ in range(40):
                new = a + (z - za) * (b - a) / (zb - za) if zb > za else (a + b) / 2
                new = min(max(new, min(a, b) + 0.02 * abs(b - a)), max(a, b) - 0.02 * abs(b - a))
                zn = zeta(new)
                if abs(zn - z) < 1e-4 or abs(b - a) < 1e-7 * (1 + abs(a)):
                    return new
                a, za, b, zb = (new, zn, b, zb) if zn < z else (a, za, new, zn)
            return (a + b) / 2

        best = float(self.theta[k])
        z0 = zeta(0.0) if best > 0 else 0.0
        lower = between(best, 0.0, 0.0, z0) if z0 > z else 0.0
        state[0] = np.concatenate([self.theta[keep], self.beta])
        a, za, b = best, 0.0, max(2 * best, 0.5)
        while (zb := zeta(b)) < z:
            if b > 1e6:
                return lower, float("inf")
            a, za, b = b, zb, 2 * b
        return lower, between(a, za, b, zb)

    def profile_interval(self, level: float = 0.95, which: list[str] | None = None) -> DataFrame:
        """term, lower, upper: limits by the profiled deviance, all else sought anew at each value.

        Of all fixed effects, and of the spreads of terms with one parameter if the family has no scale.
        """
        z, rows = norm_ppf(0.5 + level / 2), []
        se = np.sqrt(np.diag(self.vcov()))
        k = 0
        for t, part in zip(self.spec.terms, split(self.spec, self.theta), strict=True):
            name = t.structure.profile_names(t.names, t.group)[0]
            if len(part) == 1 and not self.family.has_scale and (not which or name in which):
                rows.append((name, *self._spread_limits(k, z)))
            k += len(part)
        low, up = lmm.bounds(self.spec)
        for j, name in enumerate(self.spec.x_names):
            if which and name not in which:
                continue
            keep = [k for k in range(len(self.beta)) if k != j]
            limits = []
            for sign in (-1, 1):
                state = [self.theta, self.beta[keep]]

                def rise(v: float, j: int = j, keep: list[int] = keep, state: list = state) -> float:
                    c = replace(self.cells, o=self.cells.o + v * self.cells.x[:, j], x=self.cells.x[:, keep])
                    u0 = np.zeros(c.q)
                    nt = len(low)

                    def f(par):
                        try:
                            return laplace(c, self.family, _templates(self.spec, c, par[:nt]), par[nt:], u0, False, self.n_agq)[0]
                        except (np.linalg.LinAlgError, FloatingPointError):
                            return np.inf

                    o = optimize(f, np.concatenate(state), np.concatenate([low, np.full(len(keep), -np.inf)]), np.concatenate([up, np.full(len(keep), np.inf)]), "quadratic", {"radius": 0.05, "least": 1e-5}, restart_edge=False)
                    state[0], state[1] = o.par[:nt], o.par[nt:]
                    return o.value - self.deviance

                # secant steps on zeta, which is nearly linear
                a, za = float(self.beta[j]), 0.0
                b = a + sign * z * float(se[j])
                zb = float(np.sqrt(max(0.0, rise(b))))
                for _ in range(12):
                    if abs(zb - z) < 1e-4:
                        break
                    new = b + (z - zb) * (b - a) / (zb - za)
                    a, za, b = b, zb, new
                    zb = float(np.sqrt(max(0.0, rise(b))))
                limits.append(b)
            rows.append((name, limits[0], limits[1]))
        return self.spark.createDataFrame(rows, "term string, lower double, upper double")


def drawn_effects(spec: Spec, theta: np.ndarray, sigma: float, seed: int) -> Column:
    """Z b for effects drawn by (seed, sim_id, term, level)."""
    out = F.lit(0.0)
    for number, (t, p) in enumerate(zip(spec.terms, split(spec, theta), strict=True)):
        f = sigma * t.structure.factor(p)
        us = [normal(F.lit(seed), F.col("sim_id"), F.lit(number), F.lit(j), F.col(f"`_g_{t.group}`")) for j in range(len(f))]
        for a, z in enumerate(t.columns):
            out = out + F.col(z) * sum((F.lit(float(f[a, b])) * us[b] for b in range(a + 1)), F.lit(0.0))
    return out


def draw(f: Family, mu: Column, w: Column, sigma: float, seed: int) -> Column:
    """A response of the family for each row: by a generator of its own seeded with (seed, sim_id, row), in Arrow batches.

    binomial gives a proportion of w trials, which must be whole numbers; Gamma has shape w / sigma^2, the inverse Gaussian shape
    w / sigma^2.
    """
    if f.name == "gaussian":
        return mu + F.lit(sigma) / F.sqrt(w) * normal(F.lit(seed), F.col("sim_id"), F.lit("row"), F.col("_row"))
    name, theta = f.name, f.theta
    if name not in ("binomial", "poisson", "negative.binomial", "Gamma", "inverse.gaussian"):
        raise ValueError(f"no sampler for {name}")

    def run(key: pd.Series, m: pd.Series, wt: pd.Series) -> pd.Series:
        k, m, wt = key.to_numpy(), m.to_numpy(float), wt.to_numpy(float)
        if name == "binomial" and (np.abs(wt - np.round(wt)) > 1e-9).any():
            raise ValueError("binomial draws need whole numbers of trials")
        out = np.empty(len(k))
        for i in range(len(k)):
            r = np.random.Generator(np.random.Philox(key=int(k[i]) & (2**64 - 1)))
            if name == "binomial":
                out[i] = r.binomial(int(round(wt[i])), m[i]) / wt[i] if wt[i] else 0.0
            elif name == "poisson":
                out[i] = r.poisson(m[i])
            elif name == "negative.binomial":
                out[i] = r.poisson(r.gamma(theta, m[i] / theta))
            elif name == "Gamma":
                a = wt[i] / sigma**2
                out[i] = r.gamma(a, m[i] / a)
            else:
                out[i] = r.wald(m[i], wt[i] / sigma**2)
        return pd.Series(out)

    return F.pandas_udf(run, "double")(F.xxhash64(F.lit(seed), F.col("sim_id"), F.lit("row"), F.col("_row")), mu, w)


def simulate_formula(data: DataFrame, formula: str, beta: dict[str, float], theta: np.ndarray, sigma: float = 1.0, family: str = "gaussian", link: str | None = None, nsim: int = 1, seed: int = 1, weights: str | None = None, nb_theta: float = 1.0) -> DataFrame:
    """Responses for a model that was never fitted: data nsim times with sim_id and sim. beta names every fixed effect."""
    f = Family(normal_name(family), link or DEFAULT_LINK[normal_name(family)], nb_theta)
    from mixloom.plans import formula as fm

    spec = compile_model(data, fm.with_rhs("_none ~ 1", fm.rhs(formula)).replace("_none ", "0 ", 1), weights)
    if set(beta) != set(spec.x_names):
        raise ValueError(f"fixed effects are {', '.join(spec.x_names)}")
    want = sum(t.structure.n_par for t in spec.terms)
    if len(theta) != want:
        raise ValueError(f"theta needs {want} values")
    frame = spec.frame.withColumn("_row", lmm.row_key(spec.frame)).select("*", F.explode(F.sequence(F.lit(1), F.lit(nsim))).alias("sim_id"))
    eta = sum((F.lit(float(beta[n])) * F.col(c) for n, c in zip(spec.x_names, spec.x_cols, strict=True)), F.col("_o")) + drawn_effects(spec, np.asarray(theta, float), sigma, seed)
    out = frame.withColumn("_mu", fam.link_inverse(f.link, eta))
    return out.withColumn("sim", draw(f, F.col("_mu"), F.col("_w"), sigma, seed)).select(*(F.col(f"`{c}`") for c in data.columns if c not in ("sim", "sim_id")), "sim_id", "sim")


def compile_glmm(df: DataFrame, formula: str, weights: str | None = None, offset: str | None = None, subset: str | None = None, na_action: str = "omit", contrasts: dict | None = None, control: Control | None = None) -> tuple[Spec, Cells]:
    """The first module of a generalized fit: columns, checks, cells."""
    control = control or glmm_control()
    spec = compile_model(df, formula, weights, subset, offset, na_action, contrasts)
    seen = check(spec, allow_n=True, checks=control.checks)
    if seen["lo"] == seen["hi"]:
        report(control.checks.constant_response, "the response is constant", spec.messages)
    c = collapse(spec)
    xx = lambda c: [(c.x * (c.times * c.w)[:, None]).T @ c.x]
    keep = rank_check(spec, (c.sums(xx) if isinstance(c, Shards) else xx(c))[0], control.checks)
    if len(keep) < c.p:
        spec.dropped = [n for j, n in enumerate(spec.x_names) if j not in keep]
        spec.x_names, spec.x_terms, spec.x_cols = ([x[j] for j in keep] for x in (spec.x_names, spec.x_terms, spec.x_cols))
        c = replace(c, keep=list(keep), p=len(keep)) if isinstance(c, Shards) else replace(c, x=c.x[:, keep])
    return spec, c


def glmm_criterion(spec: Spec, f: Family, c: Cells, n_agq: int, control: Control) -> tuple[Callable, Callable, list]:
    """Two functions: of theta with the fixed effects moved by PIRLS, and of theta and the fixed effects; and their state."""
    state = [np.zeros(c.p), np.zeros(c.q)]
    nt = sum(t.structure.n_par for t in spec.terms)
    bad = (np.linalg.LinAlgError, FloatingPointError)

    def first(theta):
        try:
            v, b, u = laplace(c, f, _templates(spec, c, theta), state[0], state[1] * 0, True, 1, control.tol_pirls, control.steps_pirls)
        except bad:
            return np.inf
        state[0], state[1] = b, u
        return v

    def second(x):
        try:
            return laplace(c, f, _templates(spec, c, x[:nt]), x[nt:], state[1] * 0, False, n_agq, control.tol_pirls, control.steps_pirls)[0]
        except bad:
            return np.inf

    return first, second, state


def begin(c: Cells | Shards, f: Family) -> np.ndarray:
    """Fixed effects to begin from: least squares of the link of the family's first means."""
    if isinstance(c, Shards):
        xx, xy = c.sums(lambda c: [(c.x * (c.times * c.w)[:, None]).T @ c.x, c.x.T @ (c.times * c.w * (f.forward(f.start(c.y, c.w)) - c.o))])
        return np.linalg.solve(xx, xy)
    eta = f.forward(f.start(c.y, c.w))
    w = np.sqrt(c.times * c.w)
    return np.linalg.lstsq(c.x * w[:, None], (eta - c.o) * w, rcond=None)[0]


def fit_cells(spec: Spec, f: Family, c: Cells, n_agq: int = 1, control: Control | None = None, start=None, call=None, near: bool = False) -> GLMM:
    """Stage one moves theta with beta profiled by PIRLS; stage two moves both (n_agq 0 stops after stage one).

    near says that start is close: a single theta is sought between its half and its double first.
    """
    control = control or glmm_control()
    if not 0 <= n_agq <= 100:
        raise ValueError("from 0 to 100 quadrature nodes")
    if n_agq > 1 and (len(c.factors) != 1 or c.sizes[0] != 1 or f.has_scale):
        raise ValueError("more than one quadrature node needs a single scalar term")
    low, up = lmm.bounds(spec)
    p, nt = c.p, len(low)
    first, second, state = glmm_criterion(spec, f, c, n_agq, control)
    theta0 = np.concatenate([t.structure.start() for t in spec.terms])
    state[0] = begin(c, f)
    if start is not None:
        theta0, state[0] = np.asarray(start[0], float), np.asarray(start[1], float)
    opt = None
    if nt == 1 and near and start is not None:
        lo1, hi1 = 0.5 * theta0[0], 2 * theta0[0] + 1e-3
        opt = brent(lambda x: first(np.array([x])), lo1, hi1, float(theta0[0]))
        if min(opt.par[0] - lo1, hi1 - opt.par[0]) < 1e-3 * hi1:
            opt = None  # at an end of the span
    if opt is not None:
        pass
    elif nt == 1:
        grid = [0.0, 0.05, 0.15, 0.4, 0.8, 1.6, 4.0, 8.0]
        v = [first(np.array([g])) for g in grid]
        i = int(np.argmin(v))
        opt = golden(lambda x: first(np.array([x])), grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], 1e-7)
        if v[0] <= opt.value:
            opt.par, opt.value = np.zeros(1), v[0]
    else:
        opt = optimize(first, theta0, low, up, control.optimizer, control.options, control.restart_edge, control.boundary_tol)
    theta, dev, h, messages = opt.par, first(opt.par), None, list(spec.messages)
    beta, u = state
    if n_agq:
        lo2, up2 = np.concatenate([low, np.full(p, -np.inf)]), np.concatenate([up, np.full(p, np.inf)])
        options = {"radius": 0.05} | control.options if control.optimizer == "quadratic" else control.options
        two = optimize(second, np.concatenate([theta, beta]), lo2, up2, control.optimizer, options, control.restart_edge, control.boundary_tol)
        theta, beta, dev = two.par[:nt], two.par[nt:], two.value
        u = u if isinstance(c, Shards) else pirls(c, f, _templates(spec, c, theta), beta, u * 0, False)[1]
        conv = control.convergence
        if control.derivatives and nt + p <= conv.most_parameters:
            found = [m for _, m in convergence(second, two, lo2, up2, conv.gradient_tol, conv.singular_tol, conv.hessian_tol)]
            messages += found
            if not (np.minimum(theta - low, up - theta) < conv.singular_tol).any():
                h = derivatives(second, two.par, low=lo2, up=up2)[1]
    return GLMM(spec, f, theta, beta, u, dev, c, n_agq, h, messages, call, control)


def fit_glmm(df: DataFrame, formula: str, family: str | Family = "binomial", link: str | None = None, n_agq: int = 1, weights: str | None = None, theta_nb: float = 1.0, cells: Cells | None = None, offset: str | None = None, subset: str | None = None, na_action: str = "omit", contrasts: dict | None = None, control: Control | None = None, start=None):
    """A generalized fit; a gaussian family with the identity link is a linear fit by maximum likelihood."""
    if isinstance(family, str):
        name = normal_name(family)
        if name.startswith("quasi"):
            raise ValueError("quasi families have no likelihood")
        if name not in DEFAULT_LINK:
            raise ValueError(f"unknown family {family!r}")
        if name == "gaussian" and link in (None, "identity"):
            return lmm.fit_lmm(df, formula, False, weights, subset, offset, na_action, contrasts=contrasts)
        family = Family(name, link or DEFAULT_LINK[name], theta_nb)
    spec, c = compile_glmm(df, formula, weights, offset, subset, na_action, contrasts, control)
    options = {"family": family, "n_agq": n_agq, "weights": weights, "offset": offset, "subset": subset, "na_action": na_action, "contrasts": contrasts}
    return fit_cells(spec, family, cells or c, n_agq, control, start, lmm.Call(df, formula, options))


def nb_start(m: GLMM) -> float:
    """The negative binomial's theta by moments from a Poisson fit."""
    c, (_, _, mu, _, _) = m.cells, m._state()
    over = float((c.times * ((c.y - mu) ** 2 - mu)).sum() / (c.times * mu**2).sum())
    return 1 / max(over, 1e-4)


def fit_glmm_nb(df: DataFrame, formula: str, interval: float = 3.0, tol: float = 5e-5, **options) -> GLMM:
    """Negative binomial: a Poisson fit gives a moment start for theta, then theta is searched on its log scale by refits on
    the same cells, within +- interval."""
    po = fit_glmm(df, formula, "poisson", n_agq=0, **options)
    start, state = np.log(nb_start(po)), [po.theta, po.beta]

    def at(lt: float, n_agq: int = 0) -> GLMM:
        m = fit_cells(po.spec, Family("negative.binomial", "log", float(np.exp(lt))), po.cells, n_agq, po.control, (state[0], state[1]), po.call, near=True)
        state[0], state[1] = m.theta, m.beta
        return m

    opt = brent(lambda lt: at(lt).deviance, start - interval, start + interval, float(start), tol)
    return at(float(opt.par[0]), 1)
