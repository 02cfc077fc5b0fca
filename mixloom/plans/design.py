"""From a formula and a DataFrame to a plan: response, fixed-effect and random-effect columns, checks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.functions.covstruct import Structure, make
from mixloom.plans.control import Checks, report
from mixloom.plans.formula import Formula, all_vars, parse


@dataclass(frozen=True)
class Term:
    """One random-effects term: effect columns and the grouping factor they vary by."""

    group: str
    names: tuple[str, ...]
    columns: tuple[str, ...]
    structure: Structure


@dataclass
class Spec:
    formula: Formula
    frame: DataFrame  # _y, _w, _o, _x0.., _z0.., one string column for each grouping factor, and the input's columns
    x_names: list[str]
    terms: list[Term]
    n_levels: dict[str, int] = field(default_factory=dict)
    n: int = 0
    x_terms: list[str] = field(default_factory=list)  # the formula term of each fixed-effect column
    x_cols: list[str] = field(default_factory=list)
    levels: dict[str, list] = field(default_factory=dict)  # of the factors in fixed and random effects
    contrasts: dict[str, object] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)  # fixed effects that others determine
    messages: list[str] = field(default_factory=list)
    full: DataFrame | None = None  # with the rows that nulls take out of the frame
    na_action: str = "omit"
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)  # centre and spread of columns, where autoscaled
    offset: str | None = None

    @property
    def groups(self) -> list[str]:
        return list(dict.fromkeys(t.group for t in self.terms))


def _is_text(df: DataFrame, name: str) -> bool:
    return name in df.columns and df.schema[name].dataType.typeName() in ("string", "boolean")


def levels(df: DataFrame, name: str) -> list:
    """Sorted distinct values of a factor used in the fixed effects."""
    return sorted(r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().collect())


def factorize(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as text, so that they count as factors."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def dummy(df: DataFrame, name: str, keep: list | None = None) -> DataFrame:
    """Indicator columns of a factor's levels (all but the first unless named), null where the factor is null."""
    keep = levels(df, name)[1:] if keep is None else keep
    return df.select("*", *(F.when(F.col(name).isNull(), None).when(F.col(name) == v, 1.0).otherwise(0.0).alias(f"{name}_{v}") for v in keep))


def interaction(df: DataFrame, *names: str) -> DataFrame:
    """The observed combinations of factors with their canonical order: level (names joined by :) and idx from 1.

    Only what stands together is kept; the order is that of the factors' own levels, so one sort of distinct rows.
    """
    seen = df.select(*names).dropna().distinct().select(group_key(*names).alias("level"), F.struct(*names).alias("_k"))
    parts = seen.orderBy("_k").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_first")).orderBy("_p").toPandas()  # a row for each stretch of the sort
    start = df.sparkSession.createDataFrame([(int(p), int(f), int(c)) for p, f, c in zip(before["_p"], before["_first"], before["n"].cumsum() - before["n"], strict=True)], "_p int, _first bigint, _before bigint")
    return parts.join(F.broadcast(start), "_p").select("level", (F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("idx"))


def group_key(*names: str) -> Column:
    """The level of a grouping factor as text; of several factors joined by :, with a : inside a level written \\\\:."""
    if len(names) == 1:
        return F.col(names[0]).cast("string")
    parts = [F.replace(F.replace(F.col(n).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")) for n in names]
    return F.concat(*[x for k, p in enumerate(parts) for x in ((F.lit(":"), p) if k else (p,))])


def contrast_matrix(kind, n: int) -> tuple[np.ndarray, list[str] | None]:
    """(levels, columns) of a factor's coding and the columns' names (None: by level). kind may be a matrix itself."""
    if not isinstance(kind, str):
        m = np.asarray(kind, float)
        return m, [str(k + 1) for k in range(m.shape[1])]
    if kind == "treatment":
        return np.eye(n)[:, 1:], None
    if kind == "sum":
        return np.vstack([np.eye(n - 1), -np.ones(n - 1)]), [str(k + 1) for k in range(n - 1)]
    if kind == "helmert":
        return np.array([[-1.0 if i <= j else (j + 1.0 if i == j + 1 else 0.0) for j in range(n - 1)] for i in range(n)]), [str(k + 1) for k in range(n - 1)]
    if kind == "poly":
        x = np.vander(np.arange(n) - (n - 1) / 2, n, increasing=True)
        q, r = np.linalg.qr(x)
        return (q * np.sign(np.diag(r)))[:, 1:], [{1: ".L", 2: ".Q", 3: ".C"}.get(k, f"^{k}") for k in range(1, n)]
    raise ValueError(f"unknown contrasts {kind!r}")


def _coded(df: DataFrame, v: str, full: bool, lv: list, kind) -> list[tuple[str, Column]]:
    if full:
        m, names = np.eye(len(lv)), None
    else:
        m, names = contrast_matrix(kind, len(lv))
        if m.shape[0] != len(lv):
            raise ValueError(f"the contrasts of {v} need a row for each of its {len(lv)} levels")
    out = []
    for j in range(m.shape[1]):
        label = names[j] if names else lv[int(np.argmax(m[:, j]))]
        c = F.when(F.col(v).isNull(), None)
        for i, x in enumerate(lv):
            if m[i, j]:
                c = c.when(F.col(v) == F.lit(x), float(m[i, j]))
        out.append((f"{v}{label}", c.otherwise(0.0)))
    return out


def _columns(df: DataFrame, term: tuple[str, ...], full: bool, known: dict, contrasts: dict) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = [("", F.lit(1.0))]
    for v in term:
        if _is_text(df, v):
            if v not in known:
                known[v] = levels(df, v)
            part = _coded(df, v, full, known[v], contrasts.get(v, "treatment"))
        else:
            part = [(v, F.expr(v).cast("double"))]
        out = [(f"{a}:{b}" if a else b, x * y) for a, x in out for b, y in part]
    return out


def is_nested(df: DataFrame, inner: str, outer: str) -> bool:
    """Whether every level of inner stands with one level of outer only."""
    return df.where(F.col(inner).isNotNull()).groupBy(inner).agg(F.countDistinct(outer).alias("n")).where("n > 1").limit(1).count() == 0


def expand_grid(spark, **values: list) -> DataFrame:
    """All combinations of the given values (a few short lists), one column each."""
    rows = spark.range(1).select()
    for name, v in values.items():
        rows = rows.select("*", F.explode(F.array(*map(F.lit, v))).alias(name))
    return rows


def data_template(spark, formula: str, groups: dict[str, int], per_group: int = 1, seed: int = 1) -> DataFrame:
    """A blank factorial data set for a formula: every combination of the groups' levels, per_group rows each, and standard
    normal covariates drawn by row."""
    f = parse(formula)
    rows = expand_grid(spark, **{g: [f"{g}{i + 1}" for i in range(n)] for g, n in groups.items()}, _rep=list(range(1, per_group + 1)))
    for k, v in enumerate(x for x in all_vars(formula) if x not in groups and x not in f.response):
        rows = rows.withColumn(v, normal(F.lit(seed), F.lit(k), *groups, "_rep"))
    return rows.drop("_rep")


def parameter_template(spec: Spec) -> dict:
    """Zero fixed effects, unit theta and unit sigma, named, to be filled in for a simulation."""
    theta = np.concatenate([t.structure.start() for t in spec.terms]) if spec.terms else np.zeros(0)
    return {"beta": dict.fromkeys(spec.x_names, 0.0), "theta": theta, "sigma": 1.0}


def unit(*key) -> Column:
    """A number in (0, 1) fixed by the key's values."""
    return (F.pmod(F.xxhash64(*key), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def normal(*key) -> Column:
    """A standard normal number fixed by the key's values."""
    return F.sqrt(-2 * F.log(unit(F.lit("a"), *key))) * F.cos(2 * np.pi * unit(F.lit("b"), *key))


def compile_model(df: DataFrame, formula: str, weights: str | None = None, subset: str | None = None, offset: str | None = None, na_action: str = "omit", contrasts: dict | None = None, like: Spec | None = None) -> Spec:
    """Filters, sets aside rows with nulls in the formula's variables, and lays out all columns as expressions.

    na_action: omit; exclude (the same, but results have a null row for each); fail. With `like`, levels and contrasts are
    those of that model and all rows stay. Factors may be coded by treatment (default), sum, helmert or poly contrasts, or by a matrix.
    """
    f = parse(formula)
    if not f.response and like is None:
        raise ValueError("the formula has no response")
    used = [v for v in all_vars(formula) if v in df.columns]
    unknown = [v for v in (*f.response, *(g for b in f.bars for g in b.groups)) if v not in df.columns and v.isidentifier()]
    if unknown:
        raise ValueError(f"not in the data: {', '.join(unknown)}")
    for v in f.response:
        if v in df.columns and df.schema[v].dataType.typeName() in ("array", "struct", "map"):
            raise ValueError("the response must be one number a row")
    if na_action not in ("omit", "exclude", "fail"):
        raise ValueError(f"unknown na_action {na_action!r}")
    df = df.where(subset) if subset else df
    needed = used + ([weights] if weights in df.columns else []) + ([offset] if offset in df.columns else [])
    if na_action == "fail" and needed and df.where(" or ".join(f"`{v}` is null" for v in needed)).limit(1).count():
        raise ValueError("missing values in the model's variables")
    complete = F.lit(True)
    for v in dict.fromkeys(needed):
        c = F.col(v)
        complete = complete & c.isNotNull() & (~F.isnan(c) if df.schema[v].dataType.typeName() in ("double", "float") else F.lit(True))
    kept = df if like else df.where(complete)
    known: dict = dict(like.levels) if like else {}
    contrasts = dict(like.contrasts) if like else dict(contrasts or {})
    xs: list[tuple[str, Column]] = [("(Intercept)", F.lit(1.0))] if f.intercept else []
    x_terms = [n for n, _ in xs]
    first_full = not f.intercept
    for t in f.terms:
        full = first_full and len(t) == 1 and _is_text(df, t[0])
        first_full = first_full and not full
        xs += _columns(kept, t, full, known, contrasts)
        x_terms += [":".join(t)] * (len(xs) - len(x_terms))
    extra, terms = [], []
    for k, b in enumerate(f.bars):
        zs = [z for e in b.effects for z in ([("(Intercept)", F.lit(1.0))] if not e else _columns(kept, e, () not in b.effects and len(e) == 1, known, contrasts))]
        extra += [z.alias(f"_z{k}_{j}") for j, (_, z) in enumerate(zs)]
        terms.append(Term(b.name, tuple(n for n, _ in zs), tuple(f"_z{k}_{j}" for j in range(len(zs))), make(b.structure, len(zs), b.hom)))
    groups = {b.name: group_key(*b.groups) for b in f.bars}
    if len(f.response) == 2:
        good, bad = (F.col(v).cast("double") for v in f.response)
        y, w = good / (good + bad), good + bad
    else:
        y = F.expr(f.response[0]).cast("double") if f.response else F.lit(None).cast("double")
        w = F.expr(weights).cast("double") if weights else F.lit(1.0)
    off = " + ".join(f"({x})" for x in (f.offset, offset) if x)
    columns = [y.alias("_y"), w.alias("_w"), (F.expr(off).cast("double") if off else F.lit(0.0)).alias("_o"), *(c.alias(f"_x{i}") for i, (_, c) in enumerate(xs)), *extra, *(c.alias(f"_g_{n}") for n, c in groups.items())]
    frame = kept.select("*", *columns)
    spec = Spec(f, frame, [n for n, _ in xs], terms, x_terms=x_terms, x_cols=[f"_x{i}" for i in range(len(xs))], levels=known, contrasts=contrasts, na_action=na_action, offset=offset)
    spec.full = df.select("*", complete.alias("_complete"), *columns) if na_action == "exclude" and like is None else frame
    return spec


def check(spec: Spec, allow_n: bool = False, checks: Checks = Checks()) -> dict[str, float]:
    """All data checks in one aggregate: finite response, weights not below zero, levels, sizes of terms, spreads."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.when(F.isnan("_y") | F.col("_y").isNull() | (F.abs("_y") == float("inf")), 1).otherwise(0)).alias("bad_y"), F.min("_w").alias("least_w"), F.sum((F.col("_w") > 0).cast("long")).alias("used"), F.min("_y").alias("lo"), F.max("_y").alias("hi")]
    aggs += [F.countDistinct(f"`_g_{g}`").alias(f"levels_{k}") for k, g in enumerate(spec.groups)]
    bad_z = [F.col(c).isNull() | F.isnan(c) for t in spec.terms for c in t.columns]
    aggs += [F.sum(F.greatest(F.lit(0), *(b.cast("int") for b in bad_z))).alias("bad_z")] if bad_z else []
    for c in spec.x_cols:
        aggs += [F.stddev_samp(c).alias(f"sd{c}"), F.max((~F.col(c).isin(0.0, 1.0)).cast("int")).alias(f"other{c}")]
    r = spec.frame.agg(*aggs).first()
    if r.n == 0:
        raise ValueError("0 (non-missing) cases")
    if r.bad_y:
        raise ValueError("the response is not finite everywhere")
    if bad_z and r.bad_z:
        raise ValueError("missing values in random-effects columns")
    if r.least_w is None or r.least_w < 0 or not r.used:
        raise ValueError("weights must not be negative, and not all zero")
    for k, g in enumerate(spec.groups):
        n = spec.n_levels[g] = r[f"levels_{k}"]
        if n < 2:
            report(checks.levels_above_one, f"grouping factor {g} must have 2 or more sampled levels", spec.messages)
        if n > r.n or n == r.n and not allow_n:
            report(checks.levels_below_rows, f"number of levels of {g} must be below the number of observations", spec.messages)
        if n < 5:
            report(checks.levels_above_four, f"grouping factor {g} has fewer than 5 levels", spec.messages)
    structured = any(t.structure.kind != "us" for t in spec.terms)
    for t in spec.terms:
        q = spec.n_levels[t.group] * len(t.names)
        if not structured and (q > r.n or q == r.n and not allow_n):
            report(checks.effects_below_rows, f"as many random effects ({q}) as observations for ({' + '.join(t.names)} | {t.group})", spec.messages)
    spread = {n: r[f"sd{c}"] for n, c in zip(spec.x_names, spec.x_cols, strict=True) if r[f"other{c}"] and r[f"sd{c}"]}
    if spread and checks.scale_x != "ignore":
        v = np.log10(np.array(list(spread.values())))
        if np.abs(v).max() > 3 or v.max() - v.min() > 3:
            report(checks.scale_x, "fixed-effect columns are on very different scales: consider scaling them", spec.messages)
    spec.n = r.used
    spec.terms.sort(key=lambda t: -spec.n_levels[t.group])
    return {k: float(v) for k, v in r.asDict().items() if v is not None}


def rank_check(spec: Spec, xx: np.ndarray, checks: Checks, tol: float = 1e-10) -> list[int]:
    """Fixed-effect columns that do not depend on those before them, by elimination on the sums.

    The sums square the condition number, so tol is on squared lengths: 1e-10 of a column's own is a relative length of 1e-5.
    """
    a, keep = np.array(xx, float), []
    own = np.diag(xx).copy()
    for j in range(len(a)):
        if own[j] > 0 and a[j, j] > tol * own[j]:
            keep.append(j)
            a = a - np.outer(a[:, j], a[j]) / a[j, j]
    lost = [spec.x_names[j] for j in range(len(xx)) if j not in keep]
    if lost:
        text = f"fixed-effect columns are rank deficient, {len(lost)} dropped: {', '.join(lost)}"
        report(checks.rank_x, text, spec.messages)
        if checks.rank_x == "ignore":
            return list(range(len(xx)))
    return keep


def model_frame(spec: Spec, fixed_only: bool = False) -> DataFrame:
    """The columns that the formula names, as they went into the model."""
    f = spec.formula
    names = [*f.response, *(v for t in f.terms for v in t), *(() if fixed_only else (v for b in f.bars for x in (*b.effects, b.groups) for v in x))]
    return spec.frame.select(*dict.fromkeys(v for v in names if v in spec.frame.columns))


def model_matrix(spec: Spec, kind: str = "fixed") -> DataFrame:
    """fixed: the columns of X by name; random: one row (row, term, grp, effect, value) for each entry of Z."""
    if kind == "fixed":
        return spec.frame.select(*(F.col(c).alias(n) for n, c in zip(spec.x_names, spec.x_cols, strict=True)))
    rows = spec.frame.withColumn("row", F.monotonically_increasing_id())
    entries = [F.struct(F.lit(t.group).alias("term"), F.col(f"`_g_{t.group}`").alias("grp"), F.lit(n).alias("effect"), F.col(c).alias("value")) for t in spec.terms for n, c in zip(t.names, t.columns, strict=True)]
    return rows.select("row", F.explode(F.array(*entries)).alias("e")).select("row", "e.*")


def raw_matrices(spec: Spec) -> list[tuple[str, list[str], DataFrame]]:
    """For each random-effects term, by its number of levels: the bar's text, its effects and a table of their values by row."""
    return [(f"{' + '.join(t.names)} | {t.group}", list(t.names), spec.frame.select(*(F.col(c).alias(n) for n, c in zip(t.names, t.columns, strict=True)))) for t in spec.terms]
