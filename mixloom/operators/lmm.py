"""Linear mixed models: fitting, extractors, prediction, simulation, row diagnostics."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixloom.functions.special import norm_ppf
from mixloom.operators import pls
from mixloom.operators.gram import MOST_LEVELS, Gram, factor_columns, gram, transformed, unpack, with_columns
from mixloom.operators.optimize import Optimum, convergence, golden, optimize
from mixloom.plans import formula as fm
from mixloom.plans.control import Control, check_arguments
from mixloom.plans.design import Spec, check, compile_model, normal, rank_check


@dataclass(frozen=True)
class Call:
    """What a fit was called with, for fits that repeat it with changes."""

    data: DataFrame
    formula: str
    options: dict


def quantiles(df: DataFrame, column: str, at: tuple[float, ...], buckets: int = 65_536, most: int = 100_000) -> list[float | None]:
    """Exact quantiles, interpolated between neighbouring ranks. Nulls don't count; without values all are null.

    Nothing is sorted or shuffled but counts: ranks are sought in buckets between the least and the largest value, and in
    buckets of those buckets until few values are left, or equal ones.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, lo, hi = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(at)
    if not np.isfinite([lo, hi, hi - lo]).all():
        return [x.agg(F.expr(f"percentile(x, {p})")).first()[0] for p in at]
    found: dict[int, float] = {}
    ranks = sorted({int(r) for p in at for r in (np.floor((n - 1) * p), np.ceil((n - 1) * p))})
    spans = [(lo, hi, 0, n, ranks)]  # least and largest value of a span, values below it, values in it, ranks sought there
    while spans:
        for a, b, below, _, own in spans:
            if a == b:
                found.update(dict.fromkeys(own, a))
        spans = [s for s in spans if s[0] < s[1]]
        few = [s for s in spans if s[3] <= most // len(spans)]
        if few:
            got = x.where(F.expr(" or ".join(f"x between {a!r}D and {b!r}D" for a, b, *_ in few))).toPandas().x.to_numpy()
            for a, b, below, _, own in few:
                v = np.sort(got[(got >= a) & (got <= b)])
                found.update({r: float(v[r - below]) for r in own})
        wide = [s for s in spans if s not in few]
        spans = []
        for a, b, below, _, own in wide:
            k = F.least(F.floor((F.col("x") - F.lit(a)) / F.lit(b - a) * buckets), F.lit(buckets - 1)).alias("k")
            t = x.where(F.col("x").between(a, b)).groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).toPandas().sort_values("k")  # at most `buckets` rows
            ends = below + t.n.cumsum().to_numpy()
            for i, c in enumerate(ends.tolist()):
                mine = [r for r in own if c - t.n.iloc[i] <= r < c]
                if mine:
                    spans.append((float(t.a.iloc[i]), float(t.b.iloc[i]), int(c - t.n.iloc[i]), int(t.n.iloc[i]), mine))
    out = []
    for p in at:
        r = (n - 1) * p
        i, j = int(np.floor(r)), int(np.ceil(r))
        out.append(found[i] if i == j else (j - r) * found[i] + (r - i) * found[j])
    return out


@dataclass
class LMM:
    spec: Spec
    gram: Gram
    theta: np.ndarray
    reml: bool
    solution: pls.Solution
    optimum: Optimum
    messages: list[str] = field(default_factory=list)
    call: Call | None = None
    control: Control = Control()

    # -- numbers ---------------------------------------------------------------------------------
    is_lmm, is_glmm, is_nlmm, family = True, False, False, "gaussian"

    @property
    def is_reml(self) -> bool:
        return self.reml

    @property
    def spark(self) -> SparkSession:
        return self.spec.frame.sparkSession

    @property
    def n(self) -> int:
        return self.gram.n

    @property
    def npar(self) -> int:
        return len(self.solution.beta) + len(self.theta) + 1

    @property
    def df_residual(self) -> int:
        return self.n - self.npar

    @property
    def n_groups(self) -> dict[str, int]:
        return {f.name: len(f.levels) or self.spec.n_levels[f.name] for f in self.gram.factors}

    @property
    def dims(self) -> dict[str, int]:
        return {"n": self.n, "p": len(self.solution.beta), "q": sum(self.spec.n_levels[t.group] * len(t.names) for t in self.spec.terms), "n_theta": len(self.theta), "n_terms": len(self.spec.terms), "n_factors": len(self.gram.factors), "reml": int(self.reml) * len(self.solution.beta)}

    @property
    def sigma(self) -> float:
        return float(np.sqrt(self.solution.r2 / (self.n - (len(self.solution.beta) if self.reml else 0))))

    def deviance(self, reml: bool | None = None) -> float:
        """-2 log likelihood at the model's theta: ML, or the REML criterion."""
        return pls.deviance(self.spec, self.gram, self.theta, self.reml if reml is None else reml)

    def reml_criterion(self) -> float:
        return self.deviance(True)

    def log_lik(self, reml: bool | None = None) -> float:
        return -self.deviance(reml) / 2

    def aic(self) -> float:
        return self.deviance() + 2 * self.npar

    def bic(self) -> float:
        return float(self.deviance() + np.log(self.n) * self.npar)

    def extract_aic(self, k: float = 2.0) -> tuple[int, float]:
        """Number of parameters and criterion of the ML fit."""
        m = self.refit_ml()
        return m.npar, float(m.deviance() + k * m.npar)

    def fixef(self, add_dropped: bool = False) -> dict[str, float]:
        out = dict(zip(self.spec.x_names, self.solution.beta.tolist(), strict=True))
        return out | (dict.fromkeys(self.spec.dropped, float("nan")) if add_dropped else {})

    def vcov(self, correlation: bool = False, sigma: float | None = None) -> np.ndarray:
        v = (self.sigma if sigma is None else sigma) ** 2 * np.linalg.inv(self.solution.a)
        return v / np.sqrt(np.outer(np.diag(v), np.diag(v))) if correlation else v

    def vcov_full(self) -> np.ndarray:
        """Joint covariance of the random effects, factor by factor and level by level, and the fixed effects."""
        return self.sigma**2 * pls.joint(self.spec, self.gram, self.theta)[0]

    def var_corr(self) -> list[tuple[str, tuple[str, ...], np.ndarray]]:
        par = pls.split(self.spec, self.theta)
        out = []
        for t, p in zip(self.spec.terms, par, strict=True):
            m = t.structure.factor(p)
            out.append((t.group, t.names, self.sigma**2 * m @ m.T))
        return out

    def is_singular(self, tol: float = 1e-4) -> bool:
        return any(t.structure.singular(p, tol) for t, p in zip(self.spec.terms, pls.split(self.spec, self.theta), strict=True))

    def theta_names(self) -> list[str]:
        return [n for t in self.spec.terms for n in t.structure.theta_names(t.group, t.names)]

    def par_names(self) -> list[str]:
        return [n for t in self.spec.terms for n in t.structure.par_names(t.group, t.names)]

    def deviance_function(self) -> Callable[[np.ndarray], float]:
        """The criterion as a function of the parameters, without further data access."""
        return _criterion(self.spec, self.gram, self.reml)

    def get(self, name: str):
        """A component of the fit by name; "all" gives those that are small."""
        parts = _COMPONENTS
        if name == "all":
            return {k: f(self) for k, f in parts.items() if k not in _LARGE}
        if name not in parts:
            raise KeyError(f"{name!r} is not one of {', '.join(sorted(parts))}")
        return parts[name](self)

    # -- tables ----------------------------------------------------------------------------------
    def var_corr_df(self, order: str = "cov.last") -> DataFrame:
        """grp, var1, var2, vcov, sdcor: spreads first and then correlations, or by the lower triangle's columns (lower.tri)."""
        rows = []
        for g, names, v in self.var_corr():
            rows += cov_rows(g, names, v, order)
        rows.append(("Residual", None, None, self.sigma**2, self.sigma))
        return self.spark.createDataFrame(rows, "grp string, var1 string, var2 string, vcov double, sdcor double")

    def coef_table(self) -> DataFrame:
        se = np.sqrt(np.diag(self.vcov()))
        return self.spark.createDataFrame([(n, float(b), float(s), float(b / s)) for n, b, s in zip(self.spec.x_names, self.solution.beta, se, strict=True)], "term string, estimate double, std_error double, t_value double")

    def effects(self, k: int) -> DataFrame:
        """_lv, _b, _k, _s by level of factor k: modes, their relative covariance, and its product with Z'X; arrays by row.

        Levels that the driver holds are sent as one Arrow table; those that stay distributed are solved where they are.
        """
        f, p, beta = self.gram.factors[k], len(self.solution.beta), self.solution.beta
        e = f.zz.shape[1]
        t = pls.factor_template(self.spec, self.gram, self.theta, k)
        schema = "_lv string, _b array<double>, _k array<double>, _s array<double>"

        def table(levels, b, cond, zx) -> pd.DataFrame:
            s = np.einsum("lkp,lkm->lpm", zx, cond)
            return pd.DataFrame({"_lv": levels, "_b": list(b), "_k": list(cond.reshape(len(b), e * e)), "_s": list(s.reshape(len(b), p * e))})

        if f.table is None:
            return self.spark.createDataFrame(pa.Table.from_pandas(table(f.levels, self.solution.b[k], self.solution.cond[k], f.zx), preserve_index=False), schema)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    zz, zx, zy = unpack(pdf.drop(columns="g").to_numpy(float), e, p)
                    *_, m, sx, sy = pls._level_sums(t, zz, zx, zy)
                    yield table(pdf.g.tolist(), (sy - sx @ beta) @ t.T, t @ np.linalg.inv(m) @ t.T, zx)

        return f.table.mapInPandas(run, schema)

    def ranef(self, which: str | None = None) -> DataFrame:
        """grpvar, term, grp, condval, condsd: conditional modes with their conditional standard deviations."""
        out = None
        for k, f in enumerate(self.gram.factors):
            if which not in (None, f.name):
                continue
            names = [n for i in f.terms for n in self.spec.terms[i].names]
            e = len(names)
            cells = [F.struct(F.lit(n).alias("term"), F.col("_b")[j].alias("condval"), (self.sigma * F.sqrt(F.greatest(F.lit(0.0), F.col("_k")[j * e + j]))).alias("condsd")) for j, n in enumerate(names)]
            one = self.effects(k).select(F.lit(f.name).alias("grpvar"), F.col("_lv").alias("grp"), F.explode(F.array(*cells)).alias("x")).select("grpvar", "x.term", "grp", "x.condval", "x.condsd")
            out = one if out is None else out.unionAll(one)
        return out

    def ranef_df(self) -> DataFrame:
        """ranef() with ord, the place of each level by its mode within grpvar and term."""
        return self.ranef().withColumn("ord", F.row_number().over(Window.partitionBy("grpvar", "term").orderBy("condval", "grp")))

    def coef(self, which: str | None = None) -> DataFrame:
        """Fixed effects plus conditional modes of one factor (the first) by level; a fixed effect that the model lacks is 0."""
        f, fixed = next(f for f in self.gram.factors if which in (None, f.name)), self.fixef()
        k = self.gram.factors.index(f)
        names = [n for i in f.terms for n in self.spec.terms[i].names]
        cells = [F.struct(F.lit(n).alias("term"), (F.lit(float(fixed.get(n, 0.0))) + (F.col("_b")[names.index(n)] if n in names else F.lit(0.0))).alias("value")) for n in dict.fromkeys([*fixed, *names])]
        return self.effects(k).select(F.col("_lv").alias("grp"), F.explode(F.array(*cells)).alias("x")).select("grp", "x.term", "x.value")

    def ranef_intervals(self, level: float = 0.95) -> DataFrame:
        """ranef() with lower and upper, the normal limits of each conditional mode."""
        z = F.lit(norm_ppf(0.5 + level / 2)) * F.col("condsd")
        return self.ranef().withColumn("lower", F.col("condval") - z).withColumn("upper", F.col("condval") + z)

    def re_pca(self) -> DataFrame:
        """Principal components of each factor's relative covariance, its terms together: sdev and share of the variance."""
        rows = []
        for k, f in enumerate(self.gram.factors):
            sd = np.linalg.svd(pls.factor_template(self.spec, self.gram, self.theta, k), compute_uv=False)
            total = float((sd * sd).sum())
            rows += [(f.name, i + 1, float(x), float(x * x / total) if total > 0 else float("nan")) for i, x in enumerate(sd)]
        return self.spark.createDataFrame(rows, "grp string, component int, sdev double, share double")

    def anova_terms(self) -> DataFrame:
        """Sequential sums of squares of the fixed-effect terms, in formula order, without the intercept."""
        part = (np.linalg.cholesky(self.solution.a).T @ self.solution.beta) ** 2
        rows = []
        for term in dict.fromkeys(x for x in self.spec.x_terms if x != "(Intercept)"):
            own = [i for i, x in enumerate(self.spec.x_terms) if x == term]
            ss = float(part[own].sum())
            rows.append((term, len(own), ss, ss / len(own), ss / len(own) / self.sigma**2))
        return self.spark.createDataFrame(rows, "term string, npar int, sum_sq double, mean_sq double, f_value double")

    # -- rows ------------------------------------------------------------------------------------
    def _fix(self) -> Column:
        return sum((F.lit(float(b)) * F.col(c) for b, c in zip(self.solution.beta, self.spec.x_cols, strict=True)), F.col("_o"))

    def _with_effects(self, frame: DataFrame, re_form="all", allow_new: bool = True, keep: bool = False) -> DataFrame:
        """frame with _fix = X beta + offset and _ran = Z b. Unknown levels have effect zero, or are an error that names some."""
        out, ran = frame.withColumn("_fix", self._fix()), F.lit(0.0)
        wanted = [] if re_form is None else [f for f in self.gram.factors if re_form == "all" or f.name in ([re_form] if isinstance(re_form, str) else re_form)]
        for f in wanted:
            k = self.gram.factors.index(f)
            table = self.effects(k).select(F.col("_lv").alias(f"_lv{k}"), F.col("_b").alias(f"_b{k}"), F.col("_k").alias(f"_k{k}"), F.col("_s").alias(f"_s{k}"))
            table = table if keep else table.drop(f"_k{k}", f"_s{k}")
            small = len(f.levels) * 8 * (f.zy.shape[1] + 8) < 32_000_000 and f.table is None
            out = out.join(F.broadcast(table) if small else table, out[f"`_g_{f.name}`"] == table[f"_lv{k}"], "left")
            if not allow_new:
                new = out.where(f"_lv{k} is null and `_g_{f.name}` is not null").select(f"`_g_{f.name}`").distinct().limit(6).collect()
                if new:
                    raise ValueError(f"new levels in {f.name}: {', '.join(sorted(r[0] for r in new))[:60]}")
            names = factor_columns(self.spec, f.terms)
            own = sum((F.col(z) * F.coalesce(F.col(f"_b{k}")[j], F.lit(0.0)) for j, z in enumerate(names)), F.lit(0.0))
            ran = ran + F.when(F.col(f"`_g_{f.name}`").isNotNull(), own)  # an unknown group leaves the row unknown
        out = out.withColumn("_ran", ran)
        gone = [f"{c}{k}" for k in range(len(self.gram.factors)) for c in ("_lv", "_b")]
        return out if keep else out.drop(*gone)

    def fitted(self) -> DataFrame:
        """The rows of the fit with fitted, resid, pearson and scaled_resid; with na_action exclude also those left out, as nulls."""
        out = self._with_effects(self.spec.full if self.spec.full is not None else self.spec.frame)
        whole = F.col("_complete") if "_complete" in out.columns else F.lit(True)
        return out.withColumn("fitted", F.when(whole, F.col("_fix") + F.col("_ran"))).withColumn("resid", F.col("_y") - F.col("fitted")).withColumn("pearson", F.sqrt("_w") * F.col("resid")).withColumn("scaled_resid", F.col("pearson") / F.lit(self.sigma))

    def residuals(self, kind: str = "response", scaled: bool = False) -> DataFrame:
        """fitted() with residual: response and working are y - fitted, deviance and pearson are weighted; scaled by sigma if asked."""
        column = {"response": "resid", "working": "resid", "deviance": "pearson", "pearson": "pearson"}
        if kind not in column:
            raise ValueError(f"no residuals of type {kind!r}")
        r = F.col(column[kind])
        return self.fitted().withColumn("residual", r / F.lit(self.sigma) if scaled else r)

    def plot_data(self, extreme: float = 0.05) -> DataFrame:
        """fitted() with flagged: whether a scaled residual lies in the outer share `extreme` of a normal."""
        return self.fitted().withColumn("flagged", F.abs("scaled_resid") > F.lit(norm_ppf(1 - extreme / 2)))

    def scaled_quantiles(self) -> DataFrame:
        """One row with q0..q4: minimum, quartiles and maximum of the scaled residuals."""
        return self.spark.createDataFrame([tuple(quantiles(self.fitted(), "scaled_resid", (0.0, 0.25, 0.5, 0.75, 1.0)))], "q0 double, q1 double, q2 double, q3 double, q4 double")

    def _quadratic(self, frame: DataFrame, re_form="all") -> DataFrame:
        """frame, with effects joined, and _quad: the relative variance of each row's linear predictor.

        Of one factor it comes from the level's own blocks; of several from the joint covariance, held by every worker.
        """
        p, ainv = len(self.solution.beta), np.linalg.inv(self.solution.a)
        if re_form is None or not self.gram.factors:
            d = [F.col(c) for c in self.spec.x_cols]
            return self._with_effects(frame, re_form).withColumn("_quad", sum((F.lit(float(ainv[i, j])) * d[i] * d[j] for i in range(p) for j in range(p)), F.lit(0.0)))
        if len(self.gram.factors) == 1:
            f = self.gram.factors[0]
            out = self._with_effects(frame, re_form, keep=True)
            z = [F.col(c) for c in factor_columns(self.spec, f.terms)]
            e = len(z)
            at = lambda c, i: F.coalesce(F.col(c)[i], F.lit(0.0))
            quad = sum((z[a] * z[b] * at("_k0", a * e + b) for a in range(e) for b in range(e)), F.lit(0.0))
            out = out.select("*", *((F.col(c) - sum((at("_s0", i * e + a) * z[a] for a in range(e)), F.lit(0.0))).alias(f"_d{i}") for i, c in enumerate(self.spec.x_cols)), quad.alias("_q0"))
            out = out.withColumn("_quad", F.col("_q0") + sum((F.lit(float(ainv[i, j])) * F.col(f"_d{i}") * F.col(f"_d{j}") for i in range(p) for j in range(p)), F.lit(0.0)))
            return out.drop("_lv0", "_b0", "_k0", "_s0", "_q0", *(f"_d{i}" for i in range(p)))
        v, off = pls.joint(self.spec, self.gram, self.theta)
        sent = self.spark.sparkContext.broadcast((v, [{lv: i for i, lv in enumerate(f.levels)} for f in self.gram.factors]))
        cols = [factor_columns(self.spec, f.terms) for f in self.gram.factors]
        used = [re_form == "all" or f.name in ([re_form] if isinstance(re_form, str) else re_form) for f in self.gram.factors]
        names, groups = list(self.spec.x_cols), [f"_g_{f.name}" for f in self.gram.factors]

        def quad(*series: pd.Series) -> pd.Series:
            v, places = sent.value
            q = off[-1]
            at, val = [np.tile(np.arange(q, q + len(names)), (len(series[0]), 1))], [np.column_stack([s.to_numpy(float) for s in series[: len(names)]])]
            pos = len(names) + len(groups)
            for k, zs in enumerate(cols):
                lv = series[len(names) + k].map(places[k]).to_numpy(float)
                known = ~np.isnan(lv)
                at.append(off[k] + np.where(known, lv, 0).astype(int)[:, None] * len(zs) + np.arange(len(zs)))
                val.append(np.column_stack([series[pos + j].to_numpy(float) for j in range(len(zs))]) * (known & used[k])[:, None])
                pos += len(zs)
            at, val = np.concatenate(at, axis=1), np.concatenate(val, axis=1)
            return pd.Series(np.einsum("na,nab,nb->n", val, v[at[:, :, None], at[:, None, :]], val))

        udf = F.pandas_udf(quad, "double")
        return self._with_effects(frame, re_form).withColumn("_quad", udf(*names, *(f"`{g}`" for g in groups), *(c for zs in cols for c in zs)))

    def hat(self) -> DataFrame:
        """fitted() with hat, rstudent and cooks."""
        out = self._quadratic(self.spec.frame)
        out = out.withColumn("fitted", F.col("_fix") + F.col("_ran")).withColumn("resid", F.col("_y") - F.col("fitted")).withColumn("pearson", F.sqrt("_w") * F.col("resid")).withColumn("scaled_resid", F.col("pearson") / F.lit(self.sigma))
        out = out.withColumn("hat", F.col("_w") * F.col("_quad")).drop("_quad")
        out = out.withColumn("rstudent", F.col("scaled_resid") / F.sqrt(1 - F.col("hat")))
        return out.withColumn("cooks", F.pow(F.col("pearson") / (1 - F.col("hat")), 2) * F.col("hat") / F.lit(self.sigma**2 * len(self.solution.beta)))

    def _new_frame(self, newdata: DataFrame) -> DataFrame:
        """newdata with the model's own columns: its levels and contrasts; an unknown level of a fixed factor is an error."""
        f = replace(self.spec.formula, response=())
        spec = compile_model(newdata, fm.deparse(f), like=self.spec, offset=self.spec.offset if self.spec.offset in newdata.columns else None)
        fixed = [v for v in dict.fromkeys(v for t in (*f.terms, *(e for b in f.bars for e in b.effects)) for v in t) if v in self.spec.levels]
        if fixed:
            bad = newdata.agg(*(F.collect_set(F.when(~F.col(v).isin(*self.spec.levels[v]), F.col(v).cast("string"))).alias(v) for v in fixed)).first()
            unknown = [f"{v}: {', '.join(sorted(bad[v]))[:60]}" for v in fixed if bad[v]]
            if unknown:
                raise ValueError("unknown levels in " + "; ".join(unknown))
        # columns of the fit may have been dropped or reordered; names tell which are which
        at = {n: c for n, c in zip(spec.x_names, spec.x_cols, strict=True)}
        frame = spec.frame
        moved = [(F.col(at[n]).alias(c + "_")) for n, c in zip(self.spec.x_names, self.spec.x_cols, strict=True)]
        frame = frame.select(*(F.col(f"`{c}`") for c in frame.columns if c not in spec.x_cols), *moved)
        frame = frame.withColumnsRenamed({c + "_": c for c in self.spec.x_cols})
        old = {(t.group, n): c for t in spec.terms for n, c in zip(t.names, t.columns, strict=True)}
        new = [(c, old[t.group, n]) for t in self.spec.terms for n, c in zip(t.names, t.columns, strict=True)]
        if all(a == b for a, b in new):
            return frame
        taken = set(old.values())
        return frame.select(*(F.col(f"`{c}`") for c in frame.columns if c not in taken), *(F.col(b).alias(a) for a, b in new))

    def predict(self, newdata: DataFrame | None = None, re_form="all", allow_new: bool = False, se_fit: bool = False, random_only: bool = False) -> DataFrame:
        """newdata with pred, and se if asked. re_form: 'all', names of factors, or None for the population.

        Levels and contrasts are those of the fit. New levels of a grouping factor are an error, or have effect zero and no
        variance of their own. A row with a null in what it needs is kept and has a null.
        """
        if newdata is None:
            newdata = self.call.data if self.call else self.spec.frame
        frame = self._new_frame(newdata)
        out = self._with_effects(frame, re_form, allow_new)
        if se_fit:
            out = self._quadratic(frame, re_form).withColumn("se", F.lit(self.sigma) * F.sqrt("_quad"))
        pred = F.col("_ran") if random_only else F.col("_fix") + F.col("_ran")
        return out.withColumn("pred", pred).select(*(F.col(f"`{c}`") for c in newdata.columns if c not in ("pred", "se")), "pred", *(["se"] if se_fit else []))

    def new_levels(self, newdata: DataFrame) -> DataFrame:
        """factor, level: levels of the grouping factors in newdata that the fit has not seen."""
        frame, out = self._new_frame(newdata), None
        for k, f in enumerate(self.gram.factors):
            seen = self.effects(k).select(F.col("_lv").alias("level"))
            one = frame.select(F.col(f"`_g_{f.name}`").alias("level")).dropna().distinct().join(seen, "level", "left_anti").select(F.lit(f.name).alias("factor"), "level")
            out = one if out is None else out.unionAll(one)
        return out

    def simulate(self, nsim: int = 1, seed: int = 1, use_u: bool = False, newdata: DataFrame | None = None, mean_only: bool = False, key: list[str] | None = None, re_form=None, beta: np.ndarray | None = None, theta: np.ndarray | None = None, sigma: float | None = None) -> DataFrame:
        """The frame's rows nsim times with sim; draws hang on seed, replicate, and level or row, not on partitions.

        Equal rows are told apart by their number among each other, or by the key's columns, if they name rows. use_u keeps the
        modes; re_form keeps those of the named factors and draws the others. beta, theta and sigma may be replaced.
        """
        m = self.set_params(beta, theta, sigma) if any(x is not None for x in (beta, theta, sigma)) else self
        sd = sigma if sigma is not None else self.sigma
        frame = (self.spec.frame if newdata is None else self._new_frame(newdata)).drop("sim", "sim_id")
        sims = frame.withColumn("_row", F.xxhash64(*key) if key else row_key(frame)).select("*", F.explode(F.sequence(F.lit(1), F.lit(nsim))).alias("sim_id"))
        held = "all" if use_u else re_form
        out = m._with_effects(sims, held)
        drawn = [] if use_u else [t for t in self.spec.terms if re_form is None or t.group not in ([re_form] if isinstance(re_form, str) else re_form)]
        for t, p in zip(self.spec.terms, pls.split(self.spec, m.theta), strict=True):
            if t in drawn:
                f, number = sd * t.structure.factor(p), self.spec.terms.index(t)
                us = [normal(F.lit(seed), F.col("sim_id"), F.lit(number), F.lit(j), F.col(f"`_g_{t.group}`")) for j in range(len(f))]
                for a, z in enumerate(t.columns):
                    out = out.withColumn("_ran", F.col("_ran") + F.col(z) * sum((F.lit(float(f[a, b])) * us[b] for b in range(a + 1)), F.lit(0.0)))
        noise = F.lit(0.0) if mean_only else F.lit(sd) / F.sqrt("_w") * normal(F.lit(seed), F.col("sim_id"), F.lit("row"), F.col("_row"))
        return out.withColumn("sim", F.col("_fix") + F.col("_ran") + noise)

    # -- refits ------------------------------------------------------------------------------------
    def refit_ml(self) -> LMM:
        return self if not self.reml else fit_gram(self.spec, self.gram, False, start=self.theta, control=self.control, call=self.call)

    def refit(self, response: Column | str | DataFrame) -> LMM:
        """The same model for another response: a column or expression of the frame, or a frame with its own _y. Of all sums
        only those with the response are made anew."""
        frame = response if isinstance(response, DataFrame) else self.spec.frame.withColumn("_y", response if isinstance(response, Column) else F.expr(response).cast("double"))
        if self.gram.factors and self.gram.factors[0].table is not None:
            return fit_gram(replace(self.spec, frame=frame), gram(self.spec, frame), self.reml, control=self.control)
        top, parts = response_sums(self.spec, self.gram, frame)
        g = replace(self.gram, xy=top[:-1], yy=float(top[-1]), factors=[replace(f, zy=z) for f, z in zip(self.gram.factors, parts, strict=True)])
        return fit_gram(replace(self.spec, frame=frame), g, self.reml, start=self.theta, control=self.control)

    def set_params(self, beta: np.ndarray | dict | None = None, theta: np.ndarray | None = None, sigma: float | None = None) -> LMM:
        """The model with other parameters; the modes are those given them. Names of fixed effects are checked."""
        if isinstance(beta, dict):
            if set(beta) != set(self.spec.x_names):
                raise ValueError(f"fixed effects are {', '.join(self.spec.x_names)}")
            beta = np.array([beta[n] for n in self.spec.x_names])
        par = np.asarray(self.theta if theta is None else theta, float)
        if par.shape != self.theta.shape:
            raise ValueError(f"{len(self.theta)} parameters are needed: {', '.join(self.par_names())}")
        s = pls.solve(self.spec, self.gram, par)
        if beta is not None:
            beta = np.asarray(beta, float)
            if beta.shape != s.beta.shape:
                raise ValueError(f"{len(s.beta)} fixed effects are needed: {', '.join(self.spec.x_names)}")
            from mixloom.operators.gram import shifted

            own = pls.solve(self.spec, shifted(self.gram, beta), par)
            s = replace(own, beta=beta, a=s.a, ld_rx2=s.ld_rx2)
        if sigma is not None:
            s = replace(s, r2=sigma**2 * (self.n - (len(s.beta) if self.reml else 0)))
        return replace(self, theta=par, solution=s)

    def update(self, change: str | None = None, **options) -> LMM:
        """The fit again with a changed formula (". ~ . - x") or other arguments."""
        if self.call is None:
            raise ValueError("the model does not know its call")
        formula = fm.update(self.call.formula, change) if change else self.call.formula
        options = self.call.options | options
        return fit_lmm(options.pop("data", self.call.data), formula, **options)

    def confint(self, level: float = 0.95, method: str = "wald", nsim: int = 200, seed: int = 1, kind: str = "perc") -> DataFrame:
        from mixloom.operators import inference

        return inference.confint(self, level, method, nsim, seed, kind)

    def profile(self, **options):
        from mixloom.operators import inference

        return inference.profile(self, **options)

    def influence(self, by: str = "group") -> DataFrame:
        from mixloom.operators import influence

        return influence.influence(self, by)

    def summary(self):
        from mixloom.operators.summary import summarize

        return summarize(self)

    def __str__(self) -> str:
        return str(self.summary())


def cov_rows(g: str, names, v: np.ndarray, order: str = "cov.last") -> list[tuple]:
    sd = np.sqrt(np.diag(v))
    n = len(names)
    one = lambda i, j: (g, names[i], None, float(v[i, i]), float(sd[i])) if i == j else (g, names[min(i, j)], names[max(i, j)], float(v[i, j]), float(v[i, j] / (sd[i] * sd[j])) if sd[i] * sd[j] > 0 else float("nan"))
    if order == "lower.tri":
        return [one(i, j) for j in range(n) for i in range(j, n)]
    if order != "cov.last":
        raise ValueError("order is cov.last or lower.tri")
    return [one(i, i) for i in range(n)] + [one(i, j) for j in range(n) for i in range(j + 1, n)]


def row_key(frame: DataFrame) -> Column:
    """A name for each row: a hash of its values and its number among the rows with that hash."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in frame.columns))
    return F.xxhash64(h, F.row_number().over(Window.partitionBy(h).orderBy(h)))


def response_sums(spec: Spec, g: Gram, frame: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """X'r and r'r, and Z'r by factor, of a frame with another response."""
    frame = frame.withColumn("_r", F.col("_y") - F.col("_o")).where("_w > 0")
    wr = F.col("_w") * F.col("_r")
    top = frame.agg(*(F.sum(wr * F.col(c)) for c in spec.x_cols), F.sum(wr * F.col("_r"))).first()
    parts = []
    for f in g.factors:
        zs = factor_columns(spec, f.terms)
        t = frame.groupBy(F.col(f"`_g_{f.name}`").alias("g")).agg(*(F.sum(wr * F.col(z)).alias(f"z{j}") for j, z in enumerate(zs))).toPandas().set_index("g")
        parts.append(t.reindex(f.levels).fillna(0.0).to_numpy(float))
    return np.array(top, float), parts


def _criterion(spec: Spec, g: Gram, reml: bool) -> Callable[[np.ndarray], float]:
    def f(x: np.ndarray) -> float:
        try:
            return pls.deviance(spec, g, np.asarray(x, float), reml)
        except np.linalg.LinAlgError:
            return np.inf

    return f


def bounds(spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    if not spec.terms:
        return np.zeros(0), np.zeros(0)
    return tuple(np.concatenate([t.structure.bounds()[i] for t in spec.terms]) for i in (0, 1))


def moment_start(spec: Spec, g: Gram) -> np.ndarray | None:
    """For models of intercepts only: square roots of each factor's variance of means over rows, over what is left of the
    response's variance; None where that does not exist. All from the sums."""
    if any(len(t.names) != 1 or t.names[0] != "(Intercept)" for t in spec.terms) or "(Intercept)" not in spec.x_names or any(f.table is not None for f in g.factors):
        return None
    i = spec.x_names.index("(Intercept)")
    total = g.xx[i, i]
    mean = g.xy[i] / total
    var = (g.yy - total * mean**2) / (g.n - 1)
    parts = []
    for t in spec.terms:
        f = next(f for f in g.factors if f.name == t.group)
        n = f.zz[:, 0, 0]
        parts.append(float((f.zy[:, 0] ** 2 / np.where(n > 0, n, 1.0)).sum() - total * mean**2) / (g.n - 1))
    left = var - sum(parts)
    return np.sqrt(np.array(parts) / left) if left > 0 and min(parts) >= 0 else None


def start_of(spec: Spec, g: Gram, start=None) -> np.ndarray:
    """Parameters to begin from: a vector, a dict with theta, the moment start, or each structure's own."""
    own = np.concatenate([t.structure.start() for t in spec.terms]) if spec.terms else np.zeros(0)
    if isinstance(start, dict):
        bad = set(start) - {"theta", "par", "beta", "fixef"}
        if bad:
            raise ValueError(f"unknown parts of start: {', '.join(sorted(bad))}")
        start = start.get("theta", start.get("par"))
    if start is not None:
        start = np.asarray(start, float)
        if start.shape != own.shape:
            raise ValueError(f"start needs {len(own)} values")
        return start
    found = moment_start(spec, g)
    return own if found is None else found


def fit_gram(spec: Spec, g: Gram, reml: bool = True, start=None, quiet: bool = False, control: Control = Control(), call: Call | None = None) -> LMM:
    """The optimum over theta on the sums. A single scalar theta is bracketed on a grid and found by golden section."""
    low, up = bounds(spec)
    f = _criterion(spec, g, reml)
    if not len(low):
        opt = Optimum(np.zeros(0), f(np.zeros(0)), 1, True)
    elif len(low) == 1 and control.optimizer == "quadratic":
        if start is None:
            grid = np.concatenate([[0.0], np.geomspace(1e-3, 1e3, 61 if g.factors[0].table is None else 19)])
        else:
            x = max(1e-3, float(np.asarray(start_of(spec, g, start))[0]))
            grid = np.concatenate([[0.0], x * np.geomspace(0.125, 8, 13)])
        v = [f(np.array([x])) for x in grid]
        i = int(np.argmin(v))
        if start is not None and i in (len(grid) - 1, 1) and v[0] > v[i]:
            return fit_gram(spec, g, reml, None, quiet, control, call)
        opt = golden(lambda x: f(np.array([x])), grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], 1e-10 * max(1.0, grid[i]))
        if v[0] <= opt.value:
            opt = Optimum(np.zeros(1), v[0], opt.evaluations + len(grid), True)
    else:
        opt = optimize(f, start_of(spec, g, start), low, up, control.optimizer, control.options, control.restart_edge, control.boundary_tol)
    messages = list(spec.messages)
    c = control.convergence
    if len(low) and not quiet and control.derivatives and len(low) <= c.most_parameters:
        found = [m for _, m in convergence(f, opt, low, up, c.gradient_tol, c.singular_tol, c.hessian_tol)]
        if found:
            warnings.warn("; ".join(found), stacklevel=2)
        messages += found
    return LMM(spec, g, opt.par, reml, pls.solve(spec, g, opt.par), opt, messages + opt.messages, call, control)


def compile_lmm(df: DataFrame, formula: str, weights: str | None = None, subset: str | None = None, offset: str | None = None, na_action: str = "omit", contrasts: dict | None = None, control: Control = Control()) -> Spec:
    """First module of a fit: the formula's columns and the checks of the data."""
    spec = compile_model(df, formula, weights, subset, offset, na_action, contrasts)
    check(spec, checks=control.checks)
    spec.frame = spec.frame.withColumn("_r", F.col("_y") - F.col("_o"))
    return spec


def sums_of(spec: Spec, control: Control = Control(), most_levels: int = MOST_LEVELS) -> Gram:
    """Second module: the sums, without fixed-effect columns that others determine; spec keeps the names of those.

    With autoscale, columns are centred and scaled for the sums, and the sums turned back afterwards.
    """
    if control.autoscale:
        scaled = [c for c, n in zip(spec.x_cols, spec.x_names, strict=True) if n != "(Intercept)"]
        r = spec.frame.agg(*(f(c).alias(f"{k}{c}") for c in scaled for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first() if scaled else {}
        spec.scale = {c: (float(r[f"m{c}"]), float(r[f"s{c}"]) or 1.0) for c in scaled}
        frame = spec.frame.withColumns({c: (F.col(c) - m) / s for c, (m, s) in spec.scale.items()}) if scaled else spec.frame
        g = gram(spec, frame, most_levels)
        t = np.zeros((len(spec.x_cols),) * 2)  # X = scaled X t
        one = spec.x_names.index("(Intercept)") if "(Intercept)" in spec.x_names else None
        for j, c in enumerate(spec.x_cols):
            m, s = spec.scale.get(c, (0.0, 1.0))
            t[j, j] = s
            if one is not None and j != one:
                t[one, j] = m
        if one is None:
            raise ValueError("autoscale needs an intercept")
        g = transformed(g, t)
    else:
        g = gram(spec, most_levels=most_levels)
    keep = rank_check(spec, g.xx, control.checks)
    if len(keep) < len(spec.x_cols):
        spec.dropped = [n for j, n in enumerate(spec.x_names) if j not in keep]
        spec.x_names, spec.x_terms, spec.x_cols = ([x[j] for j in keep] for x in (spec.x_names, spec.x_terms, spec.x_cols))
        g = with_columns(g, keep)
    return g


def fit_lmm(df: DataFrame, formula: str, reml: bool = True, weights: str | None = None, subset: str | None = None, offset: str | None = None, na_action: str = "omit", start=None, contrasts: dict | None = None, control: Control = Control(), devfun_only: bool = False, **other):
    """Two passes over the data (checks, sums); every theta after that costs no data access."""
    check_arguments("lmm", other, set())
    spec = compile_lmm(df, formula, weights, subset, offset, na_action, contrasts, control)
    g = sums_of(spec, control)
    if devfun_only:
        return _criterion(spec, g, reml)
    call = Call(df, formula, {"reml": reml, "weights": weights, "subset": subset, "offset": offset, "na_action": na_action, "contrasts": contrasts, "control": control})
    return fit_gram(spec, g, reml, start, control=control, call=call)


_LARGE = {"joint", "Lambda", "L", "A", "RZX", "Z", "X", "y", "mu", "flist", "mmList", "Zt", "b", "u"}
_COMPONENTS: dict[str, Callable[[LMM], object]] = {
    "beta": lambda m: m.solution.beta, "fixef": lambda m: m.fixef(), "theta": lambda m: m.theta, "par": lambda m: m.theta,
    "ST": lambda m: [t.structure.factor(p) for t, p in zip(m.spec.terms, pls.split(m.spec, m.theta), strict=True)],
    "Tlist": lambda m: [t.structure.factor(p) for t, p in zip(m.spec.terms, pls.split(m.spec, m.theta), strict=True)],
    "sigma": lambda m: m.sigma, "n": lambda m: m.n, "N": lambda m: m.n, "p": lambda m: len(m.solution.beta), "q": lambda m: m.dims["q"], "npar": lambda m: m.npar,
    "n_rtrms": lambda m: len(m.spec.terms), "n_rfacs": lambda m: len(m.gram.factors), "k": lambda m: len(m.spec.terms),
    "p_i": lambda m: [len(t.names) for t in m.spec.terms], "l_i": lambda m: [m.spec.n_levels[t.group] for t in m.spec.terms],
    "q_i": lambda m: [len(t.names) * m.spec.n_levels[t.group] for t in m.spec.terms], "m_i": lambda m: [t.structure.n_par for t in m.spec.terms], "m": lambda m: len(m.theta),
    "cnms": lambda m: [(t.group, list(t.names)) for t in m.spec.terms], "Gp": lambda m: np.cumsum([0, *(len(t.names) * m.spec.n_levels[t.group] for t in m.spec.terms)]).tolist(),
    "Tp": lambda m: np.cumsum([0, *(t.structure.n_par for t in m.spec.terms)]).tolist(), "Lind": lambda m: [t.structure.theta_index().tolist() for t in m.spec.terms],
    "lower": lambda m: bounds(m.spec)[0], "upper": lambda m: bounds(m.spec)[1], "REML": lambda m: m.dims["reml"], "is_REML": lambda m: m.reml,
    "RX": lambda m: np.linalg.cholesky(m.solution.a).T, "RXi": lambda m: np.linalg.inv(np.linalg.cholesky(m.solution.a).T), "unsc": lambda m: np.linalg.inv(m.solution.a), "RXdiag": lambda m: np.diag(np.linalg.cholesky(m.solution.a)),
    "devcomp": lambda m: {"ldL2": m.solution.ld_l2, "ldRX2": m.solution.ld_rx2, "pwrss": m.solution.r2, "ussq": m.solution.u2, "wrss": m.solution.r2 - m.solution.u2, "dev": m.deviance(False), "cmp": m.deviance(), **m.dims},
    "devfun": lambda m: m.deviance_function(), "A": lambda m: pls.joint(m.spec, m.gram, m.theta)[0], "joint": lambda m: m.vcov_full(),
    "b": lambda m: m.solution.b, "u": lambda m: [np.linalg.lstsq(pls.factor_template(m.spec, m.gram, m.theta, k), b.T, rcond=None)[0].T for k, b in enumerate(m.solution.b)],
    "Lambda": lambda m: [pls.factor_template(m.spec, m.gram, m.theta, k) for k in range(len(m.gram.factors))], "flist": lambda m: {f.name: f.levels for f in m.gram.factors},
    "X": lambda m: m.spec.frame.select(*(F.col(c).alias(n) for n, c in zip(m.spec.x_names, m.spec.x_cols, strict=True))),
    "Z": lambda m: _design("model_matrix")(m.spec, "random"), "mmList": lambda m: _design("raw_matrices")(m.spec),
    "y": lambda m: m.spec.frame.select(F.col("_y").alias("y")), "mu": lambda m: m.fitted().select(F.col("fitted").alias("mu")), "offset": lambda m: m.spec.frame.select(F.col("_o").alias("offset")), "weights": lambda m: m.spec.frame.select(F.col("_w").alias("weight")),
}


def _design(name: str) -> Callable:
    from mixloom.plans import design

    return getattr(design, name)


from mixloom.operators.inference import all_fit, anova, boot, drop1  # noqa: E402, F401  the public names of this module
