"""A regression for each group, all groups in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.family import Family, link_inverse, normal_name
from mixloom.functions.special import norm_ppf, t_ppf
from mixloom.plans import formula as formulas
from mixloom.plans.design import Spec, compile_model


def lm_list(df: DataFrame, y: str, x: str, g: str) -> DataFrame:
    """grp, n, intercept, slope, rss, df of y ~ x within each g; the slope of a group without spread is null."""
    d = df.select(F.col(g).alias("grp"), F.expr(y).cast("double").alias("y"), F.expr(x).cast("double").alias("x")).dropna()
    s = d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count(F.lit(1))).alias("sxx"), (F.var_pop("y") * F.count(F.lit(1))).alias("syy"), (F.covar_pop("x", "y") * F.count(F.lit(1))).alias("sxy"))
    slope = F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx"))
    return s.select("grp", "n", (F.col("my") - slope * F.col("mx")).alias("intercept"), slope.alias("slope"), (F.col("syy") - slope * F.col("sxy")).alias("rss"), (F.col("n") - 2).alias("df"))


def pooled_sd(fits: DataFrame) -> DataFrame:
    ok = fits.where("slope is not null and df > 0")
    return ok.agg(F.sqrt(F.sum("rss") / F.sum("df")).alias("sd"), F.sum("df").alias("df"))


def fixef(fits: DataFrame) -> DataFrame:
    return fits.agg(F.avg("intercept").alias("intercept"), F.avg("slope").alias("slope"))


def ranef(fits: DataFrame) -> DataFrame:
    m = fixef(fits).select(F.col("intercept").alias("_i"), F.col("slope").alias("_s"))  # one row
    return fits.crossJoin(F.broadcast(m)).select("grp", (F.col("intercept") - F.col("_i")).alias("intercept"), (F.col("slope") - F.col("_s")).alias("slope"))


def residuals(df: DataFrame, fits: DataFrame, y: str, x: str, g: str) -> DataFrame:
    f = fits.select(F.col("grp").alias("_grp"), F.col("intercept").alias("_i"), F.col("slope").alias("_s"))
    return df.join(f, df[g] == f["_grp"], "left").withColumn("resid", F.expr(y) - F.col("_i") - F.col("_s") * F.expr(x)).drop("_grp", "_i", "_s")


@dataclass
class LmList:
    """Regressions by group: table has grp, n, df, rss, coef and unscaled covariance (arrays in the order of names, null where a
    group cannot tell a column), and a message where a group has no fit."""

    formula: str
    names: list[str]
    table: DataFrame
    spec: Spec
    family: Family | None = None
    pool: bool = True
    options: dict | None = None

    @property
    def spark(self):
        return self.table.sparkSession

    @property
    def has_scale(self) -> bool:
        return self.family is None or self.family.has_scale

    @property
    def is_glm(self) -> bool:
        return self.family is not None

    def groups(self) -> DataFrame:
        return self.table.select("grp", "n", "message")

    def coef(self) -> DataFrame:
        """grp and a column for each coefficient of any group."""
        return self.table.select("grp", *(F.col("coef")[i].alias(n) for i, n in enumerate(self.names)))

    def pooled(self) -> tuple[float, int]:
        """The pooled standard deviation and its degrees of freedom; 1 for families without a scale."""
        r = self.table.where("message is null and df > 0").agg(F.sum("rss"), F.sum("df")).first()
        if not r[1]:
            raise ValueError("no degrees of freedom to pool")
        return (float(np.sqrt(r[0] / r[1])) if self.has_scale else 1.0), int(r[1])

    def sigma(self) -> float:
        return self.pooled()[0]

    def fixef(self) -> dict[str, float]:
        """Means of the coefficients over the groups that have them."""
        r = self.coef().agg(*(F.avg(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(self.names))).first()
        return dict(zip(self.names, r, strict=True))

    def ranef(self) -> DataFrame:
        """Coefficients less their means."""
        m = self.fixef()
        return self.coef().select("grp", *((F.col(f"`{n}`") - F.lit(m[n])).alias(n) for n in self.names))

    def confint(self, level: float = 0.95) -> DataFrame:
        """grp, term, lower, upper: by the pooled spread and t quantile, or with pool False by each group's own."""
        if self.pool:
            s, d = self.pooled()
            q = t_ppf(0.5 + level / 2, d) if self.has_scale else norm_ppf(0.5 + level / 2)
            half = lambda i: F.lit(q * s) * F.sqrt(F.col("cov")[i])
            rows = self.table
        else:
            dfs = [r[0] for r in self.table.where("df > 0").select("df").distinct().collect()]  # few distinct numbers of rows
            quant = self.spark.createDataFrame([(d, t_ppf(0.5 + level / 2, d) if self.has_scale else norm_ppf(0.5 + level / 2)) for d in dfs], "df bigint, _q double")
            rows = self.table.join(F.broadcast(quant), "df", "left")
            half = lambda i: F.col("_q") * (F.sqrt(F.col("rss") / F.col("df")) if self.has_scale else F.lit(1.0)) * F.sqrt(F.col("cov")[i])
        p = len(self.names)
        cells = [F.struct(F.lit(n).alias("term"), (F.col("coef")[i] - half(i * p + i)).alias("lower"), (F.col("coef")[i] + half(i * p + i)).alias("upper")) for i, n in enumerate(self.names)]
        return rows.select("grp", F.explode(F.array(*cells)).alias("x")).select("grp", "x.*")

    def fitted(self) -> DataFrame:
        """The rows with fitted (the mean) and resid; of groups without a fit, nulls."""
        t = self.table.select(F.col("grp").alias("_grp"), F.col("coef").alias("_coef"))
        out = self.spec.frame.join(t, F.col("_g_grp") == F.col("_grp"), "left")
        eta = sum((F.when(F.col("_coef").isNotNull(), F.coalesce(F.col("_coef")[i], F.lit(0.0))) * F.col(c) for i, c in enumerate(self.spec.x_cols)), F.col("_o"))
        mu = eta if self.family is None else link_inverse(self.family.link, eta)
        return out.withColumn("fitted", mu).withColumn("resid", F.col("_y") - F.col("fitted")).drop("_grp", "_coef")

    def log_lik(self) -> tuple[float, int]:
        """Of all groups together, with one pooled spread, and the number of parameters (linear groups)."""
        r = self.table.where("message is null").agg(F.sum("n"), F.sum("rss"), F.count(F.lit(1)), F.sum(F.size(F.filter("coef", lambda x: x.isNotNull())))).first()
        return float(-0.5 * r[0] * (np.log(2 * np.pi * r[1] / r[0]) + 1)), int(r[3]) + 1

    def update(self, change: str, df: DataFrame) -> LmList:
        """The fits again with a changed formula, on df."""
        left, _, group = self.formula.rpartition("|")
        return fit_lm_list(df, f"{formulas.update(left.strip(), change)} | {group.strip()}", **(self.options or {}))

    def summary(self) -> DataFrame:
        """grp, term, estimate, std_error (pooled, if so), t_value."""
        p = len(self.names)
        s = F.lit(self.pooled()[0]) if self.pool else F.sqrt(F.col("rss") / F.col("df"))
        cells = [F.struct(F.lit(n).alias("term"), F.col("coef")[i].alias("estimate"), (s * F.sqrt(F.col("cov")[i * p + i])).alias("std_error")) for i, n in enumerate(self.names)]
        return self.table.select("grp", F.explode(F.array(*cells)).alias("x")).select("grp", "x.*").withColumn("t_value", F.col("estimate") / F.col("std_error"))


def fit_lm_list(df: DataFrame, formula: str, family: str | None = None, link: str | None = None, weights: str | None = None, offset: str | None = None, subset: str | None = None, pool: bool = True) -> LmList:
    """A regression of its own for each group of "y ~ x1 + x2 | g"; with a family, a generalized one.

    Linear fits solve each group's sums, one aggregation for all groups. Generalized ones step through the group's distinct
    rows with counts. A group that cannot be fitted is a row with a message.
    """
    left, bar, group = formula.rpartition("|")
    if not bar:
        raise ValueError("the formula needs a group: y ~ x | g")
    options = {"family": family, "link": link, "weights": weights, "offset": offset, "subset": subset, "pool": pool}
    spec = compile_model(df.where(F.col(group.strip()).isNotNull()), left.strip(), weights, subset, offset)
    spec.frame = spec.frame.withColumn("_g_grp", F.col(group.strip()).cast("string")).withColumn("_r", F.col("_y") - F.col("_o"))
    p, xs = len(spec.x_cols), spec.x_cols
    schema = "grp string, n bigint, df bigint, rss double, coef array<double>, cov array<double>, message string"
    if family is None or normal_name(family) == "gaussian":
        w = F.col("_w")
        pairs = [(xs[i], xs[j]) for i in range(p) for j in range(i, p)] + [(x, "_r") for x in xs] + [("_r", "_r")]
        sums = spec.frame.where("_w > 0").groupBy("_g_grp").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(w * F.col(a) * F.col(b)) for a, b in pairs)).alias("s"))

        def solve(batches):
            for t in batches:
                yield pd.DataFrame([_one(g, n, np.asarray(s, float), p) for g, n, s in zip(t._g_grp, t.n, t.s, strict=True)], columns=["grp", "n", "df", "rss", "coef", "cov", "message"])

        return LmList(formula, spec.x_names, sums.mapInPandas(solve, schema), spec, None, pool, options)
    f = Family(normal_name(family), link or {"binomial": "logit", "poisson": "log", "Gamma": "inverse", "inverse.gaussian": "inverse"}[normal_name(family)])
    cells = spec.frame.where("_w > 0").groupBy("_g_grp", "_y", "_w", "_o", *xs).agg(F.count(F.lit(1)).alias("times"))

    def steps(t: pd.DataFrame) -> pd.DataFrame:
        g, n = t["_g_grp"].iloc[0], int(t.times.sum())
        x, y, w, o, times = t[xs].to_numpy(float), t._y.to_numpy(float), t._w.to_numpy(float), t._o.to_numpy(float), t.times.to_numpy(float)
        try:
            keep = _independent((x * (w * times)[:, None]).T @ x)
            x, mu = x[:, keep], f.start(y, w)
            eta, before = f.forward(mu), np.inf
            for _ in range(50):
                d = f.slope(eta)
                ww = times * w * d * d / f.variance(f.inverse(eta))
                a = (x * ww[:, None]).T @ x
                b = np.linalg.solve(a, x.T @ (ww * (eta - o + (y - f.inverse(eta)) / d)))
                eta = o + x @ b
                dev = float((times * f.dev_resid(y, f.inverse(eta), w)).sum())
                if abs(dev - before) < 1e-10 * (abs(dev) + 0.1):
                    break
                before = dev
            coef, cov = np.full(p, np.nan), np.full((p, p), np.nan)
            coef[keep], cov[np.ix_(keep, keep)] = b, np.linalg.inv(a)
            return pd.DataFrame([(g, n, n - len(keep), dev, coef.tolist(), cov.ravel().tolist(), None)], columns=["grp", "n", "df", "rss", "coef", "cov", "message"])
        except (np.linalg.LinAlgError, FloatingPointError, ValueError) as err:
            return pd.DataFrame([(g, n, 0, None, [np.nan] * p, [np.nan] * p * p, str(err))], columns=["grp", "n", "df", "rss", "coef", "cov", "message"])

    return LmList(formula, spec.x_names, cells.groupBy("_g_grp").applyInPandas(steps, schema), spec, f, pool, options)


def _independent(xx: np.ndarray, tol: float = 1e-10) -> list[int]:
    a, own, keep = np.array(xx, float), np.diag(xx).copy(), []
    for j in range(len(a)):
        if own[j] > 0 and a[j, j] > tol * own[j]:
            keep.append(j)
            a = a - np.outer(a[:, j], a[j]) / a[j, j]
    return keep


def _one(g: str, n: int, s: np.ndarray, p: int) -> tuple:
    xx = np.zeros((p, p))
    for c, (i, j) in enumerate((i, j) for i in range(p) for j in range(i, p)):
        xx[i, j] = xx[j, i] = s[c]
    at = p * (p + 1) // 2
    xy, yy, keep = s[at : at + p], s[-1], _independent(xx)
    coef, cov = np.full(p, np.nan), np.full((p, p), np.nan)
    if not keep:
        return g, n, 0, None, coef.tolist(), cov.ravel().tolist(), "no column has any spread"
    inv = np.linalg.inv(xx[np.ix_(keep, keep)])
    coef[keep], cov[np.ix_(keep, keep)] = inv @ xy[keep], inv
    return g, n, n - len(keep), max(0.0, float(yy - xy[keep] @ coef[keep])), coef.tolist(), cov.ravel().tolist(), None
