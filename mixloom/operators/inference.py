"""Comparison of models, single-term deletions, profiles, bootstrap and intervals."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.special import chi2_ppf, chi2_sf, norm_ppf
from mixloom.operators import pls
from mixloom.operators.gram import factor_columns, shifted, with_columns
from mixloom.operators.optimize import OPTIMIZERS, golden, optimize


def anova(models: list) -> DataFrame:
    """Likelihood-ratio comparison: REML fits are refitted by ML, rows ordered by the number of parameters. Where the number
    does not grow, there is no p-value."""
    ms = sorted((m.refit_ml() for m in models), key=lambda m: m.npar)
    if len({m.n for m in ms}) > 1:
        raise ValueError("models were fitted to different numbers of rows")
    rows, before = [], None
    for m in ms:
        ll = m.log_lik()
        chi, df = (max(0.0, 2 * (ll - before[0])), m.npar - before[1]) if before else (None, None)
        rows.append((m.npar, m.aic(), float(m.bic()), ll, -2 * ll, chi, df, None if not df else chi2_sf(chi, df)))
        before = (ll, m.npar)
    return ms[0].spark.createDataFrame(rows, "npar int, aic double, bic double, log_lik double, deviance double, chisq double, df int, p_value double")


def all_fit(model, optimizers: dict | None = None) -> DataFrame:
    """The model's optimum sought by every optimizer from its own theta: deviance, theta, evaluations, or the error of each."""
    from mixloom.operators.lmm import bounds

    f, (low, up) = model.deviance_function(), bounds(model.spec)
    runs = dict(OPTIMIZERS if optimizers is None else optimizers)
    if optimizers is None and len(model.theta) == 1:
        runs["golden section"] = lambda f, x, lo, hi: golden(lambda v: f(np.array([v])), float(lo[0]), 10 * float(x[0]) + 1)
    rows = []
    for name, run in runs.items():
        try:
            o = optimize(f, model.theta, low, up, run, restart_edge=False)
            rows.append((name, float(o.value), [float(x) for x in o.par], int(o.evaluations), bool(o.converged), "; ".join(o.messages) or None))
        except Exception as e:  # noqa: BLE001  an optimizer that fails is a row
            rows.append((name, None, None, None, False, f"{type(e).__name__}: {e}"))
    return model.spark.createDataFrame(rows, "optimizer string, deviance double, theta array<double>, evaluations int, converged boolean, message string")


def scope(terms) -> list[tuple[str, ...]]:
    """Terms that no other term contains."""
    return [t for t in terms if not any(set(t) < set(o) for o in terms)]


def drop1(model, df: DataFrame | None = None, test: bool | str | Callable = True, only: list[str] | None = None, k: float = 2.0) -> DataFrame:
    """The ML fit without each term that no other contains, from the same sums: weights, offset and rows are those of the model.

    test: True or "chisq" for likelihood ratios, False or "none", or a callable of the full and the smaller fit, whose number
    stands as lrt. only names the terms to drop; k is the criterion's price of a parameter. df is not needed.
    """
    from mixloom.operators.lmm import fit_gram

    full = model.refit_ml()
    rows = [("<none>", full.npar, float(full.deviance() + k * full.npar), None, None)]
    names = [":".join(t) for t in scope(model.spec.formula.terms)]
    if only is not None:
        bad = [x for x in only if x not in names]
        if bad:
            raise ValueError(f"not in the scope: {', '.join(bad)}")
        names = only
    for name in names:
        keep = [j for j, t in enumerate(model.spec.x_terms) if t != name]
        spec = replace(model.spec, x_names=[model.spec.x_names[j] for j in keep], x_cols=[model.spec.x_cols[j] for j in keep], x_terms=[model.spec.x_terms[j] for j in keep])
        m = fit_gram(spec, with_columns(model.gram, keep), False, start=full.theta, quiet=True, control=model.control)
        lost = full.npar - m.npar
        chi = float(test(full, m)) if callable(test) else max(0.0, m.deviance() - full.deviance())
        wanted = test is True or test == "chisq"
        rows.append((name, m.npar, float(m.deviance() + k * m.npar), chi if wanted or callable(test) else None, chi2_sf(chi, lost) if wanted and lost else None))
    return model.spark.createDataFrame(rows, "term string, npar int, aic double, lrt double, p_value double")


# -- profiles -------------------------------------------------------------------------------------
def profile_names(model) -> list[str]:
    return [n for t in model.spec.terms for n in t.structure.profile_names(t.names, t.group)] + ["sigma"] + list(model.spec.x_names)


def deviance_by_scale(model, scale: str = "sdcor") -> tuple[Callable[[np.ndarray], float], np.ndarray, list[str]]:
    """The ML deviance as a function of spreads, correlations and sigma (fixed effects profiled out), where it is least, and names."""
    ml = model.refit_ml()
    spec, g = ml.spec, ml.gram
    parts = pls.split(spec, ml.theta)
    best = np.concatenate([*(t.structure.profile_par(p, ml.sigma, scale) for t, p in zip(spec.terms, parts, strict=True)), [ml.sigma if scale == "sdcor" else ml.sigma**2]])

    def theta_of(v: np.ndarray) -> tuple[np.ndarray, float]:
        sigma = float(v[-1] if scale == "sdcor" else np.sqrt(max(v[-1], 0)))
        out, at = [], 0
        for t in spec.terms:
            n = t.structure.n_par
            out.append(t.structure.par_of_profile(v[at : at + n], sigma, scale))
            at += n
        return np.concatenate(out), sigma

    def f(v: np.ndarray) -> float:
        if v[-1] <= 0:
            return np.inf
        try:
            theta, sigma = theta_of(np.asarray(v, float))
            return pls.deviance(spec, g, theta, False, sigma)
        except (np.linalg.LinAlgError, FloatingPointError):
            return np.inf

    return f, best, profile_names(model)[: len(best)]


@dataclass
class Profile:
    """For each focal parameter the signed square root (zeta) of the deviance's rise, with all parameters' values there."""

    names: list[str]
    best: dict[str, float]
    rows: pd.DataFrame  # focal, zeta and a column for each parameter
    model: object = None

    def df(self) -> DataFrame:
        """focal, zeta, value of the focal parameter."""
        r = self.rows
        out = [(f, float(z), float(v)) for f, z, v in zip(r.focal, r.zeta, (r.at[i, f] for i, f in zip(r.index, r.focal, strict=True)), strict=True)]
        return self.model.spark.createDataFrame(out, "focal string, zeta double, value double")

    def curve(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows[self.rows.focal == name].sort_values("zeta")
        return r[name].to_numpy(float), r.zeta.to_numpy(float)

    def intervals(self, level: float = 0.95) -> list[tuple[str, float, float]]:
        """Where zeta crosses the normal quantiles, by the inverse spline; a side that a bound cuts off ends at the bound."""
        z = norm_ppf(0.5 + level / 2)
        out = []
        for n in dict.fromkeys(self.rows.focal):
            x, zeta = self.curve(n)
            s = Spline(zeta, x) if (np.diff(zeta) > 0).all() and len(x) > 3 else None
            ends = [(float(s(q)) if s else float(np.interp(q, zeta, x))) if zeta[0] <= q <= zeta[-1] else (float(x[0]) if q < zeta[0] else float(x[-1])) for q in (-z, z)]
            if n.startswith(("sd_", "sigma")) and zeta[0] > -z and x[0] < 1e-6:
                ends[0] = 0.0
            out.append((n, ends[0], ends[1]))
        return out

    def density(self, points: int = 101) -> DataFrame:
        """focal, value, density: the normal density of zeta times its slope, over each profile's range."""
        rows = []
        for n in dict.fromkeys(self.rows.focal):
            x, zeta = self.curve(n)
            s = Spline(x, zeta)
            at = np.linspace(x[0], x[-1], points)
            d = np.exp(-0.5 * s(at) ** 2) / np.sqrt(2 * np.pi) * s.slope(at)
            rows += [(n, float(a), float(b)) for a, b in zip(at, d, strict=True)]
        return self.model.spark.createDataFrame(rows, "focal string, value double, density double")

    def transformed(self, kind: str) -> Profile:
        """Spreads as logarithms (log) or variances (variance); curves are kept point by point."""
        f, label = {"log": (np.log, "log({})"), "variance": (np.square, "var({})")}[kind]
        spreads = [n for n in self.names if n == "sigma" or n.startswith("sd_")]
        new = {n: label.format(n) for n in spreads}
        r = self.rows.copy()
        for n in spreads:
            with np.errstate(divide="ignore"):
                r[n] = f(r[n].to_numpy(float))
        r = r.rename(columns=new)
        r["focal"] = r.focal.map(lambda n: new.get(n, n))
        r = r[[np.isfinite(r.at[i, n]) for i, n in zip(r.index, r.focal, strict=True)]]
        return Profile([new.get(n, n) for n in self.names], {new.get(n, n): float(f(v)) if n in new else v for n, v in self.best.items()}, r, self.model)

    def pairs(self) -> DataFrame:
        """For each pair of parameters the trace of the second while the first is profiled: first, second, value1, value2, zeta."""
        rows = []
        for n in dict.fromkeys(self.rows.focal):
            r = self.rows[self.rows.focal == n].sort_values("zeta")
            rows += [(n, o, float(a), float(b), float(z)) for o in self.names if o != n and o in r and r[o].notna().all() for a, b, z in zip(r[n], r[o], r.zeta, strict=True)]
        return self.model.spark.createDataFrame(rows, "first string, second string, value1 double, value2 double, zeta double")


class Spline:
    """A natural cubic spline through points with growing x."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        n, h = len(x), np.diff(self.x)
        a, r = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            r[i] = 6 * ((self.y[i + 1] - self.y[i]) / h[i] - (self.y[i] - self.y[i - 1]) / h[i - 1])
        self.m = np.linalg.solve(a, r)

    def _at(self, q):
        i = np.clip(np.searchsorted(self.x, q) - 1, 0, len(self.x) - 2)
        return i, self.x[i + 1] - self.x[i], (self.x[i + 1] - q), (q - self.x[i])

    def __call__(self, q):
        q = np.asarray(q, float)
        i, h, a, b = self._at(q)
        return self.m[i] * a**3 / (6 * h) + self.m[i + 1] * b**3 / (6 * h) + (self.y[i] / h - self.m[i] * h / 6) * a + (self.y[i + 1] / h - self.m[i + 1] * h / 6) * b

    def slope(self, q):
        q = np.asarray(q, float)
        i, h, a, b = self._at(q)
        return -self.m[i] * a**2 / (2 * h) + self.m[i + 1] * b**2 / (2 * h) + (self.y[i + 1] - self.y[i]) / h - (self.m[i + 1] - self.m[i]) * h / 6


def profile(model, which: list[str] | str | None = None, alpha: float = 0.01, points: int = 30, delta: float | None = None) -> Profile:
    """Profiles of spreads, correlations, sigma and fixed effects of the ML fit, out to the square root of the chi-squared
    quantile of 1 - alpha. which: names, or "theta" (spreads and correlations) or "beta". All from the sums."""
    from mixloom.operators.lmm import fit_gram

    ml = model.refit_ml()
    f, best, var_names = deviance_by_scale(ml)
    names = [*var_names, *ml.spec.x_names]
    chosen = names if which is None else [n for n in var_names if n != "sigma"] if which == "theta" else list(ml.spec.x_names) if which == "beta" else [which] if isinstance(which, str) else list(which)
    unknown = [n for n in chosen if n not in names]
    if unknown:
        raise ValueError(f"no parameters {', '.join(unknown)}: {', '.join(names)}")
    cutoff = float(np.sqrt(chi2_ppf(1 - alpha, len(names))))
    delta = delta or cutoff / 8
    lows = np.concatenate([*(t.structure.profile_bounds()[0] for t in ml.spec.terms), [0.0]])
    ups = np.concatenate([*(t.structure.profile_bounds()[1] for t in ml.spec.terms), [np.inf]])
    dev0 = min(f(best), ml.deviance())
    at_best = dict(zip(names, [*best.tolist(), *ml.solution.beta.tolist()], strict=True))
    rows = []

    def profiled_variance(i: int):
        rest = [k for k in range(len(best)) if k != i]
        state = [best[rest].copy()]

        def value(x: float):
            def g(v):
                full = np.empty(len(best))
                full[rest], full[i] = v, x
                return f(full)

            o = optimize(g, state[0], lows[rest], ups[rest], "quadratic", {"radius": 0.05 * max(1e-3, float(np.abs(state[0]).max()))}, restart_edge=False)
            if np.isfinite(o.value):
                state[0] = o.par
            full = np.empty(len(best))
            full[rest], full[i] = o.par, x
            return o.value, dict(zip(names, [*full.tolist(), *[np.nan] * len(ml.solution.beta)], strict=True))

        return value, lambda: state.__setitem__(0, best[rest].copy())

    def profiled_fixed(j: int):
        keep = [k for k in range(len(ml.solution.beta)) if k != j]
        state = [ml.theta]

        def value(x: float):
            one = np.zeros(len(ml.solution.beta))
            one[j] = x
            g0 = shifted(ml.gram, one)
            g = replace(with_columns(ml.gram, keep), yy=g0.yy, xy=(ml.gram.xy - ml.gram.xx @ one)[keep], factors=[replace(a, zx=a.zx[:, :, keep], zy=b.zy) for a, b in zip(ml.gram.factors, g0.factors, strict=True)])
            m = fit_gram(replace(ml.spec, x_names=[ml.spec.x_names[k] for k in keep], x_cols=[ml.spec.x_cols[k] for k in keep], x_terms=[ml.spec.x_terms[k] for k in keep]), g, False, start=state[0], quiet=True)
            state[0] = m.theta
            beta = np.insert(m.solution.beta, j, x)
            spread = np.concatenate([*(t.structure.profile_par(p, m.sigma) for t, p in zip(ml.spec.terms, pls.split(ml.spec, m.theta), strict=True)), [m.sigma]])
            return m.deviance(), dict(zip(names, [*spread.tolist(), *beta.tolist()], strict=True))

        return value, lambda: state.__setitem__(0, ml.theta)

    se = np.sqrt(np.diag(ml.vcov()))
    for n in chosen:
        i = names.index(n)
        fixed = i >= len(best)
        value, reset = profiled_fixed(i - len(best)) if fixed else profiled_variance(i)
        low, up = (-np.inf, np.inf) if fixed else (lows[i], ups[i])
        rows.append({"focal": n, "zeta": 0.0, **at_best})
        for sign in (-1, 1):
            reset()
            x, zeta = at_best[n], 0.0
            step = float(se[i - len(best)]) * delta if fixed else 0.05 * max(abs(x), 0.05)
            for _ in range(points):
                y = min(max(x + sign * step, low), up)
                if y == x:
                    break
                dev, values = value(y)
                if not np.isfinite(dev):
                    step /= 4
                    if step < 1e-9:
                        break
                    continue
                new = float(np.sqrt(max(0.0, dev - dev0)))
                rows.append({"focal": n, "zeta": sign * new, **values})
                rate = (new - zeta) / abs(y - x)
                x, zeta = y, new
                if new > cutoff:
                    break
                step = min(delta / rate, 3 * step) if rate > 1e-12 else 2 * step
    table = pd.DataFrame(rows).drop_duplicates(["focal", "zeta"])
    return Profile(names, at_best, table, ml)


# -- bootstrap ------------------------------------------------------------------------------------
def statistics(m) -> dict[str, float]:
    """What the bootstrap keeps of a fit unless told otherwise: fixed effects, theta and sigma."""
    return {**m.fixef(), **{f"theta{i}": float(x) for i, x in enumerate(m.theta)}, "sigma": float(m.sigma)}


def boot(model, nsim: int, seed: int = 1, fun: Callable | None = None, use_u: bool = False, kind: str = "parametric") -> DataFrame:
    """sim_id, name, value, message: statistics of refits to simulated responses, or the message of a refit that failed.

    Responses are drawn by row; of a replicate only its sums with the response are gathered, and refits run in parallel, one
    task for some replicates. kind semiparametric (with use_u) draws the residuals of the fit anew instead of normal ones.
    """
    if kind not in ("parametric", "semiparametric") or kind == "semiparametric" and not use_u:
        raise ValueError("kind is parametric, or with use_u semiparametric")
    if kind == "semiparametric":
        sims = resampled(model, nsim, seed)
    else:
        sims = model.simulate(nsim, seed, use_u)
    sims = sims.withColumn("_r", F.col("sim") - F.col("_o")).where("_w > 0")
    fun, spec, g = fun or statistics, replace(model.spec, frame=None, full=None), model.gram
    if g.factors and g.factors[0].table is not None:
        raise ValueError("the bootstrap needs levels that one task can hold")
    wr = F.col("_w") * F.col("_r")
    parts = sims.groupBy("sim_id").agg(F.array(*(F.sum(wr * F.col(c)) for c in spec.x_cols), F.sum(wr * F.col("_r"))).alias("v")).select("sim_id", F.lit(-1).alias("k"), F.lit("").alias("g"), "v")
    for k, f in enumerate(g.factors):
        zs = factor_columns(spec, f.terms)
        parts = parts.unionAll(sims.groupBy("sim_id", F.col(f"`_g_{f.name}`").alias("g")).agg(F.array(*(F.sum(wr * F.col(z)) for z in zs)).alias("v")).select("sim_id", F.lit(k).alias("k"), "g", "v"))
    control, theta, reml = model.control, model.theta, model.reml

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        from mixloom.operators.lmm import fit_gram

        sim = int(pdf.sim_id.iloc[0])
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                top = pdf[pdf.k == -1].v.iloc[0]
                factors = [replace(f, zy=np.stack(pdf[pdf.k == k].set_index("g").v.reindex(f.levels).to_list())) for k, f in enumerate(g.factors)]
                m = fit_gram(spec, replace(g, xy=np.array(top[:-1]), yy=float(top[-1]), factors=factors), reml, start=theta, quiet=True, control=control)
                found = fun(m)
            return pd.DataFrame([(sim, n, float(v), None) for n, v in found.items()], columns=["sim_id", "name", "value", "message"])
        except Exception as e:  # noqa: BLE001  a failed refit is a row
            return pd.DataFrame([(sim, None, None, f"{type(e).__name__}: {e}")], columns=["sim_id", "name", "value", "message"])

    return parts.groupBy("sim_id").applyInPandas(refit, "sim_id int, name string, value double, message string")


def resampled(model, nsim: int, seed: int) -> DataFrame:
    """The frame's rows nsim times with sim: fitted values plus residuals drawn with replacement, by row numbers fixed once."""
    from mixloom.operators.lmm import row_key
    from mixloom.plans.design import unit

    fit = model.fitted().where("fitted is not null")
    rows = fit.withColumn("_row", row_key(fit))
    numbered = rows.select("_row", "pearson").withColumn("_h", F.xxhash64("_row"))
    # place among all rows by (bucket of the hash, place in the bucket): no task sorts more than a bucket
    from pyspark.sql import Window

    buckets = numbered.withColumn("_b", F.pmod("_h", F.lit(4096)))
    sizes = buckets.groupBy("_b").count().orderBy("_b").toPandas()  # at most 4096 rows
    before = dict(zip(sizes["_b"], (np.cumsum(sizes["count"]) - sizes["count"]).tolist(), strict=True))
    at = F.coalesce(*(F.when(F.col("_b") == b, F.lit(n)) for b, n in before.items())) if len(before) <= 64 else F.element_at(F.create_map(*(x for b, n in before.items() for x in (F.lit(b), F.lit(n)))), F.col("_b"))
    placed = buckets.withColumn("_at", at.cast("long") + F.row_number().over(Window.partitionBy("_b").orderBy("_h")) - 1).select("_at", F.col("pearson").alias("_e"))
    total = int(sizes["count"].sum())
    sims = rows.withColumn("sim_id", F.explode(F.sequence(F.lit(1), F.lit(nsim)))).withColumn("_at", F.floor(unit(F.lit(seed), F.col("sim_id"), F.lit("pick"), F.col("_row")) * total).cast("long"))
    return sims.join(placed, "_at").withColumn("sim", F.col("fitted") + F.col("_e") / F.sqrt("_w"))


def boot_wide(reps: DataFrame) -> DataFrame:
    """A row for each replicate, a column for each statistic; failed ones are null."""
    return reps.groupBy("sim_id").pivot("name").agg(F.first("value")).drop("null")


def boot_intervals(reps: DataFrame, level: float, kind: str, at: dict[str, float]) -> list[tuple[str, float, float]]:
    a = (1 - level) / 2
    got = reps.where("name is not null").groupBy("name").agg(F.expr(f"percentile(value, array({a}, {1 - a}))").alias("q"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()
    z, out = norm_ppf(1 - a), {}
    for r in got:
        t0 = at.get(r["name"], r.m)
        if kind == "perc":
            out[r["name"]] = (r.q[0], r.q[1])
        elif kind == "basic":
            out[r["name"]] = (2 * t0 - r.q[1], 2 * t0 - r.q[0])
        elif kind == "norm":
            out[r["name"]] = (2 * t0 - r.m - z * r.s, 2 * t0 - r.m + z * r.s)
        else:
            raise ValueError("kind is perc, basic or norm")
    return [(n, float(out[n][0]), float(out[n][1])) for n in [*(n for n in at if n in out), *sorted(n for n in out if n not in at)]]


def confint(model, level: float = 0.95, method: str = "wald", nsim: int = 200, seed: int = 1, kind: str = "perc") -> DataFrame:
    """term, lower, upper. wald: fixed effects (spreads and correlations have none: wald_all lists them as nulls); profile: all parameters; boot."""
    if method in ("wald", "wald_all"):
        z = norm_ppf(0.5 + level / 2)
        se = np.sqrt(np.diag(model.vcov()))
        rows = [(n, float(b - z * s), float(b + z * s)) for n, b, s in zip(model.spec.x_names, model.solution.beta, se, strict=True)]
        if method == "wald_all":
            rows = [(n, None, None) for n in profile_names(model)[: -len(rows)]] + rows
    elif method == "profile":
        rows = profile(model).intervals(level)
    elif method == "boot":
        rows = boot_intervals(boot(model, nsim, seed), level, kind, statistics(model))
    else:
        raise ValueError(f"unknown method {method}")
    return model.spark.createDataFrame(rows, "term string, lower double, upper double")
