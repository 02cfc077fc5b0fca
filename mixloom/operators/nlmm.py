"""Nonlinear mixed models: y = curve(parameters, covariates) + noise, parameters with fixed parts and random effects by group.

The curve is an arithmetic expression; its slopes by parameter come from complex steps, which are exact to rounding. Rows that
agree in all variables and the group are one cell with a count. Many cells stay distributed, as those of generalized models.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.covstruct import make
from mixloom.operators import lmm
from mixloom.operators import glmm
from mixloom.operators.glmm import Cells, Shards, System, _spherical
from mixloom.operators.optimize import brent, golden, optimize
from mixloom.operators.pls import split
from mixloom.plans.control import Control, nlmm_control
from mixloom.plans.design import Spec, Term, group_key
from mixloom.plans.formula import Formula, Nonlinear, parse_nonlinear

_FUNCTIONS = {"exp": np.exp, "log": np.log, "sqrt": np.sqrt, "power": np.power, "sin": np.sin, "cos": np.cos, "tanh": np.tanh}


def curve_function(curve: str, names: list[str]) -> Callable[[dict], np.ndarray]:
    """The expression as a function of arrays by name; only arithmetic, the known functions and the given names are let in."""
    used = set(re.findall(r"[A-Za-z_.][\w.]*", curve))
    unknown = used - set(names) - set(_FUNCTIONS)
    if unknown or re.search(r"[^\w\s.+\-*/(),]", curve):
        raise ValueError(f"the curve may use {', '.join(sorted(_FUNCTIONS))} and columns; not {', '.join(sorted(unknown)) or 'other signs'}")
    plain = {n: re.sub(r"\W", "_", n) for n in names}
    for n in sorted(names, key=len, reverse=True):
        if plain[n] != n:
            curve = re.sub(rf"(?<![\w.]){re.escape(n)}(?![\w.])", plain[n], curve)
    code = compile(curve, "<curve>", "eval")
    return lambda v: eval(code, {"__builtins__": {}}, {**_FUNCTIONS, **{plain[k]: x for k, x in v.items()}})  # noqa: S307  checked above


def logistic_curve(x: str = "x", asym: str = "Asym", mid: str = "xmid", scale: str = "scal") -> str:
    """The three-parameter logistic growth curve as an expression."""
    return f"{asym} / (1 + exp(({mid} - {x}) / {scale}))"


@dataclass
class Data:
    y: np.ndarray
    times: np.ndarray
    covariates: dict[str, np.ndarray]
    level: np.ndarray
    levels: list[str]


@dataclass
class NLMM:
    nonlinear: Nonlinear
    spec: Spec
    theta: np.ndarray
    beta: np.ndarray
    u: np.ndarray
    deviance: float
    data: Data | Shards
    pwrss: float
    information: np.ndarray
    n_agq: int = 1
    messages: list[str] = field(default_factory=list)
    call: lmm.Call | None = None

    is_lmm, is_glmm, is_nlmm, is_reml, reml, family = False, False, True, False, False, "gaussian"

    @property
    def spark(self):
        return self.spec.frame.sparkSession

    @property
    def n(self) -> int:
        return self.data.n if isinstance(self.data, Shards) else int(self.data.times.sum())

    @property
    def n_groups(self) -> dict[str, int]:
        return {self.spec.groups[0]: self.data.n_levels if isinstance(self.data, Shards) else len(self.data.levels)}

    @property
    def npar(self) -> int:
        return len(self.beta) + len(self.theta) + 1

    @property
    def df_residual(self) -> int:
        return self.n - self.npar

    @property
    def sigma(self) -> float:
        return float(np.sqrt(self.pwrss / self.n))

    def log_lik(self, reml: bool | None = None) -> float:
        return -self.deviance / 2

    def aic(self) -> float:
        return self.deviance + 2 * self.npar

    def bic(self) -> float:
        return float(self.deviance + np.log(self.n) * self.npar)

    def refit_ml(self) -> NLMM:
        return self

    def fixef(self) -> dict[str, float]:
        return dict(zip(self.nonlinear.parameters, self.beta.tolist(), strict=True))

    def vcov(self) -> np.ndarray:
        return self.sigma**2 * np.linalg.inv(self.information)

    def var_corr(self):
        return [(t.group, t.names, self.sigma**2 * t.structure.factor(p) @ t.structure.factor(p).T) for t, p in zip(self.spec.terms, split(self.spec, self.theta), strict=True)]

    def modes(self) -> np.ndarray:
        """(levels, effects): modes of the parameters' random effects."""
        if isinstance(self.data, Shards):
            raise ValueError(f"modes of nonlinear models need at most {glmm.MOST_CELLS} distinct cells")
        t = _template(self.spec, self.theta)
        return self.u.reshape(-1, len(t)) @ t.T

    def ranef(self) -> DataFrame:
        names = [n for t in self.spec.terms for n in t.names]
        b = self.modes()
        return self.spark.createDataFrame([(self.spec.groups[0], n, lv, float(b[i, j])) for i, lv in enumerate(self.data.levels) for j, n in enumerate(names)], "grpvar string, term string, grp string, condval double")

    def fitted(self, newdata: DataFrame | None = None, population: bool = False) -> DataFrame:
        """Rows with fitted, the curve at each group's parameters; of a new group, or for the population, at the fixed ones."""
        frame = self.spec.frame if newdata is None else newdata.withColumn(f"_g_{self.spec.groups[0]}", group_key(*self.spec.groups[0].split(":")))
        names = [n for t in self.spec.terms for n in t.names]
        table = self.spark.createDataFrame([(lv, b.tolist()) for lv, b in zip(self.data.levels, self.modes(), strict=True)], "_lv string, _b array<double>")
        out = frame.join(F.broadcast(table), frame[f"`_g_{self.spec.groups[0]}`"] == table["_lv"], "left")
        value = {p: F.lit(float(b)) + (F.coalesce(F.col("_b")[names.index(p)], F.lit(0.0)) if p in names and not population else F.lit(0.0)) for p, b in zip(self.nonlinear.parameters, self.beta, strict=True)}
        out = out.withColumns({f"_p_{p}": c for p, c in value.items()})
        curve = self.nonlinear.curve
        for p in self.nonlinear.parameters:
            curve = re.sub(rf"(?<![\w.]){re.escape(p)}(?![\w.])", f"`_p_{p}`", curve)
        return out.withColumn("fitted", F.expr(curve)).drop("_lv", "_b", *(f"_p_{p}" for p in self.nonlinear.parameters))

    def predict(self, newdata: DataFrame, population: bool = False) -> DataFrame:
        return self.fitted(newdata, population).withColumnRenamed("fitted", "pred").select(*newdata.columns, "pred")

    def summary(self):
        from mixloom.operators.summary import summarize

        return summarize(self)

    def __str__(self) -> str:
        return str(self.summary())


def _template(spec: Spec, theta: np.ndarray) -> np.ndarray:
    blocks = [t.structure.factor(p) for t, p in zip(spec.terms, split(spec, theta), strict=True)]
    out, at = np.zeros((sum(map(len, blocks)),) * 2), 0
    for b in blocks:
        out[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return out


def stacked(df: DataFrame, parameters: list[str]) -> DataFrame:
    """The rows once for each parameter, with indicator columns 0 or 1 named as the parameters."""
    rows = df.withColumn("_par", F.explode(F.array(*map(F.lit, parameters))))
    return rows.select("*", *((F.col("_par") == p).cast("double").alias(p) for p in parameters))


def _stepper(data: Data, curve: str, covariates: list[str], names: list[str], places: list[int], n_terms: int, steps: int, tol: float) -> Callable:
    """The inner steps on these cells: a function of the template, fixed parameters, random effects, and whether the fixed ones move."""
    f, e = curve_function(curve, [*covariates, *names]), len(places)
    at = data.level[:, None] * e + np.arange(e)

    def slopes(phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.ones(len(data.y))
        mu = np.real(f({**data.covariates, **{p: phi[:, i] for i, p in enumerate(names)}}) * one)
        j = np.empty((len(data.y), len(names)))
        for i, p in enumerate(names):
            moved = {q: phi[:, k].astype(complex) for k, q in enumerate(names)}
            moved[p] = moved[p] + 1e-20j
            j[:, i] = np.imag(f({**data.covariates, **moved}) * one) / 1e-20
        return mu, j

    def phi_of(tt, beta, u):
        phi = np.tile(beta, (len(data.y), 1))
        np.add.at(phi.T, places, (u.reshape(-1, e) @ tt.T)[data.level].T)
        return phi

    def inner(tt, beta, u, move: bool):
        """Gauss-Newton steps with halving until the penalised sum of squares settles."""

        def pss(beta, u):
            with np.errstate(all="ignore"):
                mu = f({**data.covariates, **{p: phi_of(tt, beta, u)[:, i] for i, p in enumerate(names)}})
                return float((data.times * (data.y - mu) ** 2).sum() + u @ u)

        now = pss(beta, u)
        for _ in range(steps):
            mu, j = slopes(phi_of(tt, beta, u))
            c = Cells(data.y, np.ones(len(data.y)), 0 * data.y, data.times, j, j[:, places], at, [data.levels], [e], [list(range(n_terms))])
            s = System(c, data.times, _spherical(c, [tt]))
            r = data.times * (data.y - mu)
            gu = s.gather(r) - u
            if move:
                su = s.solve(gu)
                db = np.linalg.solve(s.a, j.T @ r - s.zx.T @ su)
                du = su - s.sx @ db
            else:
                db, du = np.zeros(len(names)), s.solve(gu)
            step = 1.0
            while step > 1e-6:
                new = pss(beta + step * db, u + step * du)
                if np.isfinite(new) and new <= now + 1e-13 * abs(now):
                    break
                step /= 2
            else:
                break
            beta, u = beta + step * db, u + step * du
            done = abs(now - new) <= tol * (abs(new) + 1e-10)
            now = new
            if done:
                break
        mu, j = slopes(phi_of(tt, beta, u))
        c = Cells(data.y, np.ones(len(data.y)), 0 * data.y, data.times, j, j[:, places], at, [data.levels], [e], [list(range(n_terms))])
        s, r = System(c, data.times, _spherical(c, [tt])), data.times * (data.y - mu)
        s.rhs = j.T @ r - s.zx.T @ s.solve(s.gather(r) - u)
        return beta, u, now, s

    return inner


@dataclass
class Sums:
    """What fits read of a System, summed over parts."""

    a: np.ndarray
    rhs: np.ndarray
    ld: float

    def logdet(self) -> float:
        return self.ld


def _sharded(shards: Shards, plan: tuple) -> Callable:
    """The same on cells that stay distributed: each part finds its modes, the fixed parameters move by the sums."""
    steps, tol = plan[-2:]

    def state(tt, beta):
        def own(data: Data) -> list:
            try:
                _, _, pss, s = _stepper(data, *plan)(tt, beta, np.zeros(len(data.levels) * len(tt)), False)
            except (np.linalg.LinAlgError, FloatingPointError):
                return [np.nan] * 4
            return [pss, s.a, s.rhs, s.logdet()]

        pss, a, rhs, ld = shards.sums(own)
        return float(pss), Sums(a, rhs, float(ld))

    def inner(tt, beta, u, move: bool):
        now, s = state(tt, beta)
        if not np.isfinite(now):
            raise FloatingPointError("the sum of squares is not a number")
        for _ in range(steps if move else 0):
            db, step = np.linalg.solve(s.a, s.rhs), 1.0
            if np.abs(db).max() <= 1e-9 * (1e-3 + np.abs(beta).max()):
                break
            while step > 1e-6:
                new, t = state(tt, beta + step * db)
                if np.isfinite(new) and new <= now + 1e-13 * abs(now):
                    break
                step /= 2
            else:
                break
            beta, s, done = beta + step * db, t, abs(now - new) <= tol * (abs(new) + 1e-10)
            now = new
            if done:
                break
        return beta, u, now, s

    return inner


def _as_data(t: pd.DataFrame, covariates: list[str]) -> Data:
    t = t.sort_values(list(t.columns))
    levels = sorted(t._g.unique())
    return Data(t._y.to_numpy(float), t._times.to_numpy(float), {c: t[c].to_numpy(float) for c in covariates}, np.searchsorted(levels, t._g.to_numpy()), levels)


def _collapsed(frame: DataFrame, covariates: list[str], group: str, e: int, p: int) -> Data | Shards:
    cells = frame.groupBy("_y", *covariates, F.col(f"`_g_{group}`").alias("_g")).agg(F.count(F.lit(1)).alias("_times")).persist(StorageLevel.DISK_ONLY)
    try:
        n = cells.count()
        if not n:
            raise ValueError("0 (non-missing) cases")
        if n <= glmm.MOST_CELLS:
            return _as_data(cells.toPandas(), covariates)

        def pack(part: pa.Table) -> pa.Table:
            t = part.drop_columns(["_part"]).to_pandas()
            return pa.table({"cells": pa.array([pickle.dumps(_as_data(t, covariates))], pa.binary()), "n": [int(t["_times"].sum())], "levels": [t["_g"].nunique()]})

        packed = cells.withColumn("_part", F.pmod(F.xxhash64("_g"), F.lit(-(-n // glmm.PART)))).groupBy("_part").applyInArrow(pack, "cells binary, n bigint, levels bigint").persist(StorageLevel.DISK_ONLY)
        seen = packed.agg(F.sum("n"), F.sum("levels")).first()
        return Shards(packed.select("cells"), [e], [[0]], int(seen[0]), int(seen[1]), p)
    finally:
        cells.unpersist()


def fit_nlmm(df: DataFrame, formula: str, start: dict[str, float], n_agq: int = 1, control: Control | None = None) -> NLMM:
    """response ~ curve ~ random effects, e.g. "y ~ A * exp(-k * t) ~ (A | g)"; start has a value for each parameter.

    One grouping factor. n_agq 0 profiles the fixed parameters in the inner steps, 1 moves them with theta; more is refused.
    Rows with nulls are left out.
    """
    control = control or nlmm_control()
    if n_agq not in (0, 1):
        raise ValueError("nonlinear models take n_agq 0 or 1")
    nl = parse_nonlinear(formula, list(start))
    groups = list(dict.fromkeys(b.name for b in nl.bars))
    if len(groups) != 1:
        raise ValueError("nonlinear models take one grouping factor")
    used = set(re.findall(r"[A-Za-z_.][\w.]*", nl.curve))
    missing = set(start) - used
    if missing:
        raise ValueError(f"parameters that the curve lacks: {', '.join(sorted(missing))}")
    covariates = [c for c in df.columns if c in used and c not in start]
    curve_function(nl.curve, [*covariates, *start])
    df = df.dropna(subset=[nl.response, *covariates, *nl.bars[0].groups])
    frame = df.select("*", F.col(nl.response).cast("double").alias("_y"), group_key(*nl.bars[0].groups).alias(f"_g_{groups[0]}"))
    names = list(start)
    terms = [Term(b.name, tuple(e[0] for e in b.effects), tuple(e[0] for e in b.effects), make(b.structure, len(b.effects), b.hom)) for b in nl.bars]
    places = [names.index(n) for term in terms for n in term.names]
    data = _collapsed(frame, covariates, groups[0], len(places), len(names))
    far = isinstance(data, Shards)
    n, n_levels = (data.n, data.n_levels) if far else (int(data.times.sum()), len(data.levels))
    spec = Spec(Formula((nl.response,), (), False, nl.bars), frame, names, terms, {groups[0]: n_levels}, n)

    plan = (nl.curve, covariates, names, places, len(terms), control.steps_pirls, control.tol_pirls)
    inner = _sharded(data, plan) if isinstance(data, Shards) else _stepper(data, *plan)
    state = [np.array([float(start[p]) for p in names]), np.zeros(0 if far else n_levels * len(places))]
    low, up = lmm.bounds(spec)
    nt = len(low)

    def value(theta, beta, move):
        try:
            b, u, pw, s = inner(_template(spec, theta), beta, state[1] * 0, move)
        except (np.linalg.LinAlgError, FloatingPointError):
            return np.inf, beta, state[1], np.inf, None
        return s.logdet() + n * (1 + np.log(2 * np.pi * pw / n)), b, u, pw, s

    def first(theta):
        v, b, *_ = value(theta, state[0], True)
        if np.isfinite(v):
            state[0] = b
        return v

    if nt == 1:
        grid = [0.05, 0.2, 0.6, 1.5, 4.0, 12.0, 40.0]
        v = [first(np.array([g])) for g in grid]
        i = int(np.argmin(v))
        lo1, hi1 = grid[max(0, i - 1)] if i else 0.0, grid[min(len(grid) - 1, i + 1)]
        opt = brent(lambda x: first(np.array([x])), lo1, hi1, grid[i] if 0 < i < len(grid) - 1 else (lo1 + hi1) / 2, 1e-6) if far else golden(lambda x: first(np.array([x])), lo1, hi1, 1e-7)
    else:
        opt = optimize(first, np.concatenate([t.structure.start() for t in terms]), low, up, control.optimizer, control.options, control.restart_edge)
    theta, beta = opt.par, state[0]
    if n_agq:
        width = np.concatenate([np.maximum(0.05, 0.1 * np.abs(theta)), np.maximum(1e-3, 0.02 * np.abs(beta))])
        scaled = lambda x: value(x[:nt] * width[:nt], x[nt:] * width[nt:], False)[0]
        two = optimize(scaled, np.concatenate([theta, beta]) / width, np.concatenate([low / width[:nt], np.full(len(names), -np.inf)]), np.full(nt + len(names), np.inf), "quadratic", {"radius": 0.5}, control.restart_edge)
        theta, beta = two.par[:nt] * width[:nt], two.par[nt:] * width[nt:]
    dev, beta, u, pw, s = value(theta, beta, not n_agq)
    return NLMM(nl, spec, theta, beta, u, float(dev), data, float(pw), s.a, n_agq, [], lmm.Call(df, formula, {"start": start, "n_agq": n_agq}))
