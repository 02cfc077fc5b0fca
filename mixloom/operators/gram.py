"""One pass of grouped sums: the sufficient statistics of a linear mixed model, and their algebra on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.plans.design import Spec

#: Random effects of all factors but the largest, whose cross products are one dense matrix on the driver.
MOST_DENSE = 4000
#: Levels of a factor whose sums are taken to the driver. Beyond, a model of one factor evaluates them where they are.
MOST_LEVELS = 2_000_000


@dataclass
class Factor:
    """Sums of one grouping factor: k effects (those of all its terms in turn) by level."""

    name: str
    levels: list[str]
    zz: np.ndarray  # (l, k, k)
    zx: np.ndarray  # (l, k, p)
    zy: np.ndarray  # (l, k)
    terms: list[int]
    table: DataFrame | None = None  # the sums by level, where they stay distributed


@dataclass
class Gram:
    n: int
    sum_log_w: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    factors: list[Factor]
    #: For each pair of factors the levels that meet, and their cross products: (m,), (m,), (m, k, k').
    cross: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def _sums(pairs: list[tuple[str, str]]):
    return [F.sum(F.col("_w") * F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]


def factor_columns(spec: Spec, terms: list[int]) -> list[str]:
    return [c for i in terms for c in spec.terms[i].columns]


def _pairs(spec: Spec, zs: list[str]) -> list[tuple[str, str]]:
    k = len(zs)
    return [(zs[i], zs[j]) for i in range(k) for j in range(i, k)] + [(z, x) for z in zs for x in spec.x_cols] + [(z, "_r") for z in zs]


def unpack(m: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """zz, zx and zy of the rows of sums, in the order of _pairs."""
    zz = np.zeros((len(m), k, k))
    for c, (i, j) in enumerate((i, j) for i in range(k) for j in range(i, k)):
        zz[:, i, j] = zz[:, j, i] = m[:, c]
    at = k * (k + 1) // 2
    return zz, m[:, at : at + k * p].reshape(-1, k, p), m[:, at + k * p : at + k * p + k]


def gram(spec: Spec, frame: DataFrame | None = None, most_levels: int = MOST_LEVELS) -> Gram:
    """The sums. Each grouping factor is one groupBy with map-side combination: the shuffle grows with levels, not rows.

    Rows of weight zero add nothing and don't count.
    """
    frame = spec.frame if frame is None else frame
    frame = frame.withColumn("_r", F.col("_y") - F.col("_o")).where("_w > 0")
    p, xs = len(spec.x_cols), spec.x_cols
    upper = [(xs[i], xs[j]) for i in range(p) for j in range(i, p)]
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("_w")).alias("lw"), *_sums([*upper, *((x, "_r") for x in xs), ("_r", "_r")])).first()
    v = np.array(row[2:], float)
    xx = np.zeros((p, p))
    for (a, b), s in zip(((i, j) for i in range(p) for j in range(i, p)), v, strict=False):
        xx[a, b] = xx[b, a] = s
    factors = []
    for g in spec.groups:
        own = [i for i, t in enumerate(spec.terms) if t.group == g]
        zs = factor_columns(spec, own)
        k = len(zs)
        got = frame.groupBy(F.col(f"`_g_{g}`").alias("g")).agg(*_sums(_pairs(spec, zs)))
        if spec.n_levels.get(g, 0) > most_levels:
            if len(spec.groups) > 1:
                raise ValueError(f"{g} has more than {most_levels} levels, which only models of one grouping factor may have")
            factors.append(Factor(g, [], np.zeros((0, k, k)), np.zeros((0, k, p)), np.zeros((0, k)), own, got))
            continue
        t = got.orderBy("g").toPandas()
        factors.append(Factor(g, t.g.tolist(), *unpack(t.drop(columns="g").to_numpy(float), k, p), own))
    out = Gram(row.n, float(row.lw), xx, v[len(upper) : len(upper) + p], float(v[-1]), factors)
    sizes = sorted(f.zy.size for f in factors)
    if sum(sizes[:-1]) > MOST_DENSE:
        raise ValueError(f"crossed factors with more than {MOST_DENSE} random effects beside the largest factor's")
    for (i, a), (j, b) in combinations(enumerate(factors), 2):
        za, zb = factor_columns(spec, a.terms), factor_columns(spec, b.terms)
        t = frame.groupBy(F.col(f"`_g_{a.name}`").alias("a"), F.col(f"`_g_{b.name}`").alias("b")).agg(*_sums([(x, y) for x in za for y in zb])).toPandas()
        t = t.assign(ia=pd.Index(a.levels).get_indexer(t.a), ib=pd.Index(b.levels).get_indexer(t.b)).sort_values(["ia", "ib"])
        out.cross[i, j] = (t.ia.to_numpy(), t.ib.to_numpy(), t.drop(columns=["a", "b", "ia", "ib"]).to_numpy(float).reshape(-1, len(za), len(zb)))
    return out


def with_columns(g: Gram, keep: list[int]) -> Gram:
    """The sums of the model with those fixed-effect columns only."""
    return transformed(g, np.eye(len(g.xx))[:, keep])


def transformed(g: Gram, t: np.ndarray) -> Gram:
    """The sums with X replaced by X t."""
    return Gram(g.n, g.sum_log_w, t.T @ g.xx @ t, t.T @ g.xy, g.yy, [Factor(f.name, f.levels, f.zz, f.zx @ t, f.zy, f.terms, f.table) for f in g.factors], g.cross)


def shifted(g: Gram, beta: np.ndarray) -> Gram:
    """The sums with X beta taken from the response, and without X: random effects alone."""
    factors = [Factor(f.name, f.levels, f.zz, f.zx[:, :, :0], f.zy - f.zx @ beta, f.terms) for f in g.factors]
    return Gram(g.n, g.sum_log_w, np.zeros((0, 0)), np.zeros(0), float(g.yy - 2 * g.xy @ beta + beta @ g.xx @ beta), factors, g.cross)
