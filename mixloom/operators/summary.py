"""Summaries of fits: small tables as plain data, and their printed form."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from mixloom.functions.special import norm_cdf


@dataclass
class Summary:
    title: str
    formula: str
    family: str | None
    link: str | None
    criteria: dict[str, float]
    coefficients: list[tuple]  # name, estimate, standard error, t or z, p (generalized models)
    var_corr: list[tuple]  # group, name, variance, spread, correlations with those before
    n: int
    groups: dict[str, int]
    correlation: np.ndarray
    residuals: dict[str, float] | None = None
    messages: list[str] = field(default_factory=list)
    residual_sd: float | None = None

    def __str__(self) -> str:
        out = [self.title] + ([f" Family: {self.family} ( {self.link} )"] if self.family not in (None, "gaussian") else []) + [f"Formula: {self.formula}", ""]
        out += ["  ".join(f"{k:>10}" for k in self.criteria), "  ".join(f"{v:10.1f}" for v in self.criteria.values()), ""]
        if self.residuals:
            out += ["Scaled residuals:", "  ".join(f"{k:>8}" for k in self.residuals), "  ".join(f"{v:8.4f}" for v in self.residuals.values()), ""]
        out += ["Random effects:", f" {'Groups':<12}{'Name':<16}{'Variance':>12}{'Std.Dev.':>10}  Corr"]
        before = None
        for g, name, var, sd, cor in self.var_corr:
            out.append(f" {g if g != before else '':<12}{name:<16}{var:12.5g}{sd:10.4g}  {' '.join(f'{c:.2f}' for c in cor)}".rstrip())
            before = g
        if self.residual_sd is not None:
            out.append(f" {'Residual':<12}{'':<16}{self.residual_sd**2:12.5g}{self.residual_sd:10.4g}")
        out += [f"Number of obs: {self.n}, groups:  " + "; ".join(f"{g}, {n}" for g, n in self.groups.items()), "", "Fixed effects:"]
        generalized = any(len(c) > 4 and c[4] is not None for c in self.coefficients)
        wide = max([len(c[0]) for c in self.coefficients] + [0])
        out.append(f"{'':<{wide}} {'Estimate':>10} {'Std. Error':>10} {'z value' if generalized else 't value':>8}" + (f" {'Pr(>|z|)':>9}" if generalized else ""))
        out += [f"{n:<{wide}} {b:10.5g} {s:10.4g} {t:8.3f}" + (f" {p:9.3g}" if p is not None else "") for n, b, s, t, p in self.coefficients]
        return "\n".join(out + [""] * bool(self.messages) + self.messages)


def _title(m) -> str:
    if m.is_lmm:
        return "Linear mixed model fit by " + ("REML" if m.reml else "maximum likelihood")
    how = "maximum likelihood" + (" (Adaptive Gauss-Hermite Quadrature, nAGQ = %d)" % m.n_agq if m.n_agq != 1 else " (Laplace Approximation)")
    return ("Nonlinear" if m.is_nlmm else "Generalized linear") + " mixed model fit by " + how


def criteria(m) -> dict[str, float]:
    """AIC, BIC, log likelihood, deviance and residual degrees of freedom; of a REML fit its criterion."""
    if m.is_lmm and m.reml:
        return {"REML": m.deviance()}
    return {"AIC": m.aic(), "BIC": m.bic(), "logLik": m.log_lik(), "deviance": -2 * m.log_lik(), "df.resid": float(m.df_residual)}


def summarize(m) -> Summary:
    v = m.vcov()
    se = np.sqrt(np.diag(v))
    beta = list(m.fixef().items())
    coefficients = [(n, float(b), float(s), float(b / s), None if m.is_lmm or m.is_nlmm else 2 * (1 - norm_cdf(abs(b / s)))) for (n, b), s in zip(beta, se, strict=True)]
    rows = []
    for g, names, cov in m.var_corr():
        sd = np.sqrt(np.diag(cov))
        rows += [(g, n, float(cov[i, i]), float(sd[i]), [float(cov[i, j] / (sd[i] * sd[j])) if sd[i] * sd[j] > 0 else float("nan") for j in range(i)]) for i, n in enumerate(names)]
    family = m.family if isinstance(m.family, str) else m.family.name
    link = None if isinstance(m.family, str) else m.family.link
    residuals = None
    if m.is_lmm:
        r = m.scaled_quantiles().first()
        residuals = dict(zip(("Min", "1Q", "Median", "3Q", "Max"), r, strict=True))
    from mixloom.plans.formula import deparse

    formula = m.call.formula if getattr(m, "call", None) else deparse(m.spec.formula)
    has_scale = m.is_lmm or m.is_nlmm or m.family.has_scale
    return Summary(_title(m), formula, family, link, criteria(m), coefficients, rows, m.n, m.n_groups, v / np.outer(se, se), residuals, list(m.messages), m.sigma if has_scale else None)
