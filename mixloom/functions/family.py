"""Distributions and links, each as Spark columns and as numpy functions of the same meaning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixloom.functions.special import norm_ppf

EPS = 2.220446049250313e-16  # fixed value: the least step that extreme predictors are clamped to


def _yl(y: Column, mu: Column) -> Column:
    return F.when(y == 0, F.lit(0.0)).otherwise(y * F.log(y / mu))


def variance(family: str, mu: Column, theta: float = 1.0) -> Column:
    return {"binomial": lambda: mu * (1 - mu), "poisson": lambda: mu, "Gamma": lambda: mu * mu, "gaussian": lambda: mu * 0 + 1.0, "inverse.gaussian": lambda: mu * mu * mu, "negative.binomial": lambda: mu + mu * mu / F.lit(float(theta))}[family]()


def dev_resid(family: str, y: Column, mu: Column, w: Column, theta: float = 1.0) -> Column:
    """Squared deviance residuals."""
    th = F.lit(float(theta))
    return {
        "binomial": lambda: 2 * w * (_yl(y, mu) + _yl(1 - y, 1 - mu)),
        "poisson": lambda: 2 * w * (_yl(y, mu) - (y - mu)),
        "Gamma": lambda: -2 * w * (F.when(y == 0, F.lit(0.0)).otherwise(F.log(y / mu)) - (y - mu) / mu),
        "gaussian": lambda: w * (y - mu) * (y - mu),
        "inverse.gaussian": lambda: w * (y - mu) * (y - mu) / (y * mu * mu),
        "negative.binomial": lambda: 2 * w * (_yl(y, mu) - (y + th) * F.log((y + th) / (mu + th))),
    }[family]()


def _vector(f):
    """A numpy function as a pandas UDF of one column; null stays null."""
    return F.pandas_udf(lambda x: pd.Series(f(x.to_numpy(float))).where(x.notna()), "double")


def link_inverse(link: str, eta: Column) -> Column:
    e = F.lit(EPS)
    return {
        "probit": lambda: F.least(1 - e, _vector(lambda x: 0.5 * _erfc(-x / math.sqrt(2)))(eta)),
        "identity": lambda: eta,
        "log": lambda: F.greatest(F.exp(eta), e),
        "logit": lambda: F.least(1 - e, F.greatest(e, 1 / (1 + F.exp(-eta)))),
        "cloglog": lambda: F.greatest(e, F.least(1 - e, -F.expm1(-F.exp(eta)))),
        "cauchit": lambda: F.least(1 - e, 0.5 + F.atan(eta) / math.pi),
        "inverse": lambda: 1 / eta,
    }[link]()


def mu_eta(link: str, eta: Column) -> Column:
    e = F.lit(EPS)
    p = 1 / (1 + F.exp(-eta))
    return {
        "probit": lambda: F.greatest(e, F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)),
        "identity": lambda: eta * 0 + 1.0,
        "log": lambda: F.greatest(F.exp(eta), e),
        "logit": lambda: F.greatest(e, p * (1 - p)),
        "cloglog": lambda: F.greatest(e, F.exp(eta - F.exp(eta))),
        "cauchit": lambda: 1 / (math.pi * (1 + eta * eta)),
        "inverse": lambda: -1 / (eta * eta),
    }[link]()


def link(name: str, mu: Column) -> Column:
    """The link itself; probit's is found by bisection in a UDF."""
    return {
        "identity": lambda: mu,
        "log": lambda: F.log(mu),
        "logit": lambda: F.log(mu / (1 - mu)),
        "probit": lambda: _vector(np.vectorize(lambda v: norm_ppf(v) if v == v else v, otypes=[float]))(mu),
        "cloglog": lambda: F.log(-F.log1p(-mu)),
        "cauchit": lambda: F.tan(math.pi * (mu - 0.5)),
        "inverse": lambda: 1 / mu,
    }[name]()


def aic_term(family: str, y: Column, mu: Column, w: Column, theta: float = 1.0) -> Column:
    """What a row adds to -2 log likelihood; for families without a scale of their own."""
    lg = lambda c: _vector(lgamma)(c.cast("double"))
    th = F.lit(float(theta))
    k = F.round(y * w)
    return {
        "binomial": lambda: -2 * (lg(w + 1) - lg(k + 1) - lg(w - k + 1) + k * F.log(mu) + (w - k) * F.log1p(-mu)),
        "poisson": lambda: -2 * w * (y * F.log(mu) - mu - lg(y + 1)),
        "negative.binomial": lambda: -2 * w * (lg(y + th) - lg(th) - lg(y + 1) + th * F.log(th / (th + mu)) + y * F.log(mu / (th + mu))),
    }[family]()


def working_columns(df, family: str, link_name: str, y: str, eta: str, w: str = "1.0", offset: str = "0.0", theta: float = 1.0):
    """df with everything a step of the fit uses by row: mu, mu_eta, variance, dev_resid, wrk_resid, wrk_resp, sqrt_wrk_wt, wt_wrk_resp."""
    df = df.withColumns({"mu": link_inverse(link_name, F.expr(eta)), "mu_eta": mu_eta(link_name, F.expr(eta))})
    mu, me = F.col("mu"), F.col("mu_eta")
    df = df.withColumns({"variance": variance(family, mu, theta), "dev_resid": dev_resid(family, F.expr(y), mu, F.expr(w), theta), "wrk_resid": (F.expr(y) - mu) / me})
    df = df.withColumns({"wrk_resp": F.expr(eta) - F.expr(offset) + F.col("wrk_resid"), "sqrt_wrk_wt": me * F.sqrt(F.expr(w) / F.col("variance"))})
    return df.withColumn("wt_wrk_resp", F.col("sqrt_wrk_wt") * F.col("wrk_resp"))


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)
def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function: Stirling's series from 8 on, brought there for less; not above 0 by the library."""
    x = np.asarray(x, float)
    if not (x > 0).all():
        return np.vectorize(math.lgamma, otypes=[float])(x)
    low = x < 8
    shift = np.where(low, np.log(np.where(low, x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7), 1.0)), 0.0)
    x = np.where(low, x + 8, x)
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.91893853320467274178 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / x - shift


def _xlog(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 0.0, x * np.log(np.where(x == 0, 1.0, ratio)))


@dataclass(frozen=True)
class Family:
    """numpy side: name, link, and theta of the negative binomial."""

    name: str
    link: str
    theta: float = 1.0

    @property
    def has_scale(self) -> bool:
        return self.name not in ("binomial", "poisson", "negative.binomial")

    def inverse(self, eta: np.ndarray) -> np.ndarray:
        if self.link == "log":
            return np.maximum(np.exp(np.minimum(eta, 700)), EPS)
        if self.link == "logit":
            return np.clip(1 / (1 + np.exp(-np.clip(eta, -700, 700))), EPS, 1 - EPS)
        if self.link == "probit":
            return np.clip(0.5 * _erfc(-eta / math.sqrt(2)), EPS**2, 1 - EPS)
        if self.link == "cloglog":
            return np.clip(-np.expm1(-np.exp(np.minimum(eta, 700))), EPS, 1 - EPS)
        if self.link == "cauchit":
            return np.minimum(0.5 + np.arctan(eta) / math.pi, 1 - EPS)
        return 1 / eta if self.link == "inverse" else eta

    def slope(self, eta: np.ndarray) -> np.ndarray:
        if self.link == "log":
            return np.maximum(np.exp(np.minimum(eta, 700)), EPS)
        if self.link == "logit":
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            return np.maximum(p * (1 - p), EPS)
        if self.link == "probit":
            return np.maximum(np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi), EPS)
        if self.link == "cloglog":
            return np.maximum(np.exp(np.minimum(eta, 700) - np.exp(np.minimum(eta, 700))), EPS)
        if self.link == "cauchit":
            return 1 / (math.pi * (1 + eta * eta))
        return -1 / (eta * eta) if self.link == "inverse" else np.ones_like(eta)

    def forward(self, mu: np.ndarray) -> np.ndarray:
        """The link of mu."""
        return {"log": np.log, "logit": lambda m: np.log(m / (1 - m)), "probit": np.vectorize(norm_ppf, otypes=[float]), "cloglog": lambda m: np.log(-np.log1p(-m)), "cauchit": lambda m: np.tan(math.pi * (m - 0.5)), "inverse": lambda m: 1 / m, "identity": lambda m: m}[self.link](mu)

    def start(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Means to begin from: the response, moved inside the family's range."""
        if self.name == "binomial":
            return (w * y + 0.5) / (w + 1)
        if self.name in ("poisson", "negative.binomial"):
            return y + 0.1
        return y if self.name == "gaussian" else np.full(len(y), float(np.average(y, weights=w)))

    def variance(self, mu: np.ndarray) -> np.ndarray:
        return {"binomial": mu * (1 - mu), "poisson": mu, "Gamma": mu**2, "gaussian": np.ones_like(mu), "inverse.gaussian": mu**3, "negative.binomial": mu + mu**2 / self.theta}[self.name]

    def dev_resid(self, y: np.ndarray, mu: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Squared deviance residuals."""
        if self.name == "binomial":
            return 2 * w * (_xlog(y, y / mu) + _xlog(1 - y, (1 - y) / (1 - mu)))
        if self.name == "poisson":
            return 2 * w * (_xlog(y, y / mu) - (y - mu))
        if self.name == "negative.binomial":
            return 2 * w * (_xlog(y, y / mu) - (y + self.theta) * np.log((y + self.theta) / (mu + self.theta)))
        if self.name == "Gamma":
            return -2 * w * (np.log(np.where(y == 0, 1.0, y / mu)) - (y - mu) / mu)
        return w * (y - mu) ** 2 / (y * mu * mu if self.name == "inverse.gaussian" else 1.0)

    def minus2loglik(self, y: np.ndarray, mu: np.ndarray, w: np.ndarray, times: np.ndarray) -> np.ndarray:
        """-2 log density of each cell, times the rows it stands for (w: trials of a binomial)."""
        if self.name == "binomial":
            k = np.round(y * w)
            return -2 * times * (lgamma(w + 1) - lgamma(k + 1) - lgamma(w - k + 1) + k * np.log(mu) + (w - k) * np.log1p(-mu))
        if self.name == "poisson":
            return -2 * times * w * (y * np.log(mu) - mu - lgamma(y + 1))
        if self.name == "negative.binomial":
            th = self.theta
            return -2 * times * w * (lgamma(y + th) - lgamma(np.full_like(y, th)) - lgamma(y + 1) + th * np.log(th / (th + mu)) + y * np.log(mu / (th + mu)))
        raise ValueError(f"{self.name} has a scale: see aic()")

    def aic(self, y: np.ndarray, mu: np.ndarray, w: np.ndarray, times: np.ndarray) -> float:
        """-2 log likelihood of all cells; of a family with a scale at its deviance by weight, and 2 for that parameter."""
        if not self.has_scale:
            return float(self.minus2loglik(y, mu, w, times).sum())
        return self.aic_of(self.aic_sums(y, mu, w, times))

    def aic_sums(self, y: np.ndarray, mu: np.ndarray, w: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sums over cells from which aic follows: they add up over parts of the cells."""
        if not self.has_scale:
            return np.array([self.minus2loglik(y, mu, w, times).sum()])
        tw = times * w
        out = [(times * self.dev_resid(y, mu, w)).sum(), tw.sum(), times.sum(), (times * np.log(w)).sum()]
        out += [0.0] if self.name == "gaussian" else [(tw * np.log(y)).sum()]
        return np.array(out + ([(tw * y / mu).sum(), (tw * np.log(mu)).sum()] if self.name == "Gamma" else []))

    def aic_of(self, sums: np.ndarray) -> float:
        if not self.has_scale:
            return float(sums[0])
        dev, total, n, log_w, log_y = sums[:5].tolist()
        if self.name == "gaussian":
            return n * (math.log(2 * math.pi * dev / n) + 1) + 2 - log_w
        if self.name == "inverse.gaussian":
            return total * (math.log(2 * math.pi * dev / total) + 1) + 3 * log_y + 2
        a = total / dev  # the gamma's shape
        return float(-2 * ((a - 1) * log_y - a * sums[5] - a * (sums[6] - total * math.log(a)) - total * math.lgamma(a)) + 2)


@dataclass(frozen=True)
class UserFamily(Family):
    """A family from callables on numpy arrays: link, inverse and slope of the link, variance, squared deviance residuals, and
    -2 log likelihood (y, mu, w, times) of all cells."""

    functions: tuple = ()

    def _own(self, k: int):
        return self.functions[k]

    @property
    def has_scale(self) -> bool:
        return False

    def forward(self, mu):
        return self._own(0)(mu)

    def inverse(self, eta):
        return self._own(1)(eta)

    def slope(self, eta):
        return self._own(2)(eta)

    def variance(self, mu):
        return self._own(3)(mu)

    def dev_resid(self, y, mu, w):
        return self._own(4)(y, mu, w)

    def aic(self, y, mu, w, times):
        return float(self._own(5)(y, mu, w, times))

    def aic_sums(self, y, mu, w, times):
        raise ValueError("a user family needs its cells on the driver")

    def start(self, y, w):
        return y + 0.1


def user_family(name: str, link, inverse, slope, variance, dev_resid, aic) -> UserFamily:
    return UserFamily(name, "user", 1.0, (link, inverse, slope, variance, dev_resid, aic))


def normal_name(name: str) -> str:
    """A family's name without spaces, parameters and case of its usual spellings."""
    plain = name.split("(")[0].strip().lower().replace(" ", "").replace("_", ".")
    return {"gamma": "Gamma", "inversegaussian": "inverse.gaussian", "negativebinomial": "negative.binomial", "nbinom": "negative.binomial", "normal": "gaussian"}.get(plain, plain)


def is_negative_binomial(name: str) -> bool:
    return normal_name(name) == "negative.binomial"


def has_no_scale(name: str) -> bool:
    return normal_name(name) in ("binomial", "poisson", "negative.binomial")
