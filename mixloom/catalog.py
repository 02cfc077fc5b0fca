"""Registered queries of the modelling library and the SQL that answers each.

Most use the fixture y = l_extendedprice / 10000 + 2 sin(l_suppkey) ~ l_quantity + (1 | l_suppkey), at theta 0.5.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.functions import covstruct, family
from mixloom.operators import glmm, lmlist, lmm, nlmm, plotdata, pls
from mixloom.operators.optimize import Optimum
from mixloom.plans import design
from mixloom.plans.control import Control
from mixloom.sources.tables import read_table
from mixloom.streaming.gram_state import grouped_sums, merge_sums

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
Y = "l_extendedprice / 10000D + 2 * sin(l_suppkey)"
FORMULA = "y ~ l_quantity + (1 | l_suppkey)"
THETA = 0.5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").withColumn("y", F.expr(Y))


def at_theta(spark: SparkSession, d: str, reml: bool = True, theta: float = THETA, formula: str = FORMULA, frame: DataFrame | None = None, control: Control = Control(), **options) -> lmm.LMM:
    """The model at a given theta, through the modules of a fit."""
    spec = lmm.compile_lmm(lines(spark, d) if frame is None else frame, formula, control=control, **options)
    g = lmm.sums_of(spec, control)
    par = np.array([theta])
    return lmm.LMM(spec, g, par, reml, pls.solve(spec, g, par), Optimum(par, pls.deviance(spec, g, par, reml), 1, True), control=control)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A REML fit: fixed effects, variance components and conditional modes as one table."""
    m = lmm.fit_lmm(lines(spark, d), FORMULA)
    fixed = m.coef_table().select(F.lit("fixed").alias("part"), "term", F.lit(None).cast("string").alias("grp"), F.col("estimate").alias("value"))
    var = m.var_corr_df().select(F.lit("sdcor"), F.coalesce("var1", F.lit("")), "grp", "sdcor")
    return fixed.union(var).union(m.ranef().select(F.lit("mode"), "term", "grp", "condval"))


_T = "t as (select l_extendedprice / 10000.0::double + 2 * sin(l_suppkey) as y, l_quantity as x, l_suppkey as g, * from lineitem)"


def _sql(body: str, theta: float = THETA) -> str:
    """Sums, the profiled solution at theta and its variances, as CTEs t, j (levels), s (one row)."""
    return f"""with {_T},
j as (select g, count(*)::double as n, sum(x) as sx, sum(y) as sy, {theta * theta}::double / (1 + {theta * theta}::double * count(*)) as k, ln(1 + {theta * theta}::double * count(*)) as ld from t group by g),
w as (select count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy from t),
a as (select w.n as n, w.n - sum(k * j.n * j.n) as a11, w.sx - sum(k * j.n * j.sx) as a12, w.sxx - sum(k * j.sx * j.sx) as a22, w.sy - sum(k * j.n * j.sy) as c1, w.sxy - sum(k * j.sx * j.sy) as c2, w.syy - sum(k * j.sy * j.sy) as r0, sum(ld) as ld from j, w group by w.n, w.sx, w.sy, w.sxx, w.sxy, w.syy),
b as (select *, a11 * a22 - a12 * a12 as det from a),
c as (select *, (a22 * c1 - a12 * c2) / det as b0, (a11 * c2 - a12 * c1) / det as b1 from b),
s as (select *, r0 - b0 * c1 - b1 * c2 as r2, sqrt((r0 - b0 * c1 - b1 * c2) / (n - 2)) as sigma from c)
{body}"""


@query("gram_scalar", f"with {_T} select g::varchar as grp, count(*) as n, round(sum(x), 4) as sx, round(sum(y), 4) as sy, round(sum(x * x), 3) as sxx, round(sum(x * y), 3) as sxy, round(sum(y * y), 3) as syy from t group by g")
def gram_scalar(spark, d):
    s = grouped_sums(lines(spark, d), "y", "l_quantity", "l_suppkey")
    return s.select(F.col("grp").cast("string").alias("grp"), "n", *(F.round(c, k).alias(c) for c, k in (("sx", 4), ("sy", 4), ("sxx", 3), ("sxy", 3), ("syy", 3))))


@query("gram_merge", f"with {_T} select g::varchar as grp, count(*) as n, round(sum(x), 4) as sx, round(sum(y), 4) as sy from t group by g")
def gram_merge(spark, d):
    t = lines(spark, d)
    parts = [grouped_sums(t.where(f"l_linenumber % 2 = {k}"), "y", "l_quantity", "l_suppkey") for k in (0, 1)]
    return merge_sums(*parts).select(F.col("grp").cast("string").alias("grp"), "n", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


@query("lmm_fixef", _sql("select '(Intercept)' as term, round(b0, 6) as estimate, round(sigma * sqrt(a22 / det), 6) as std_error from s union all select 'l_quantity', round(b1, 6), round(sigma * sqrt(a11 / det), 6) from s"))
def lmm_fixef(spark, d):
    return at_theta(spark, d).coef_table().select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query("lmm_vcov", _sql("select round(sigma * sigma * a22 / det, 8) as v11, round(-sigma * sigma * a12 / det, 8) as v12, round(sigma * sigma * a11 / det, 10) as v22 from s"))
def lmm_vcov(spark, d):
    v = at_theta(spark, d).vcov()
    return spark.createDataFrame([(float(v[0, 0]), float(v[0, 1]), float(v[1, 1]))], "v11 double, v12 double, v22 double").select(F.round("v11", 8).alias("v11"), F.round("v12", 8).alias("v12"), F.round("v22", 10).alias("v22"))


@query("lmm_ranef", _sql("select 'l_suppkey' as grpvar, g::varchar as grp, round(k * (j.sy - j.n * b0 - j.sx * b1), 5) as condval, round(sigma * sqrt(k), 6) as condsd from j, s"))
def lmm_ranef(spark, d):
    return at_theta(spark, d).ranef().select("grpvar", "grp", F.round("condval", 5).alias("condval"), F.round("condsd", 6).alias("condsd"))


@query("lmm_coef_levels", _sql("select g::varchar as grp, '(Intercept)' as term, round(b0 + k * (j.sy - j.n * b0 - j.sx * b1), 5) as value from j, s union all select g::varchar, 'l_quantity', round(b1, 5) from j, s"))
def lmm_coef_levels(spark, d):
    return at_theta(spark, d).coef().select("grp", "term", F.round("value", 5).alias("value"))


@query("lmm_varcorr", _sql(f"select 'l_suppkey' as grp, round(sigma * sigma * {THETA**2}, 5) as vcov, round(sigma * {THETA}, 6) as sdcor from s union all select 'Residual', round(sigma * sigma, 5), round(sigma, 6) from s"))
def lmm_varcorr(spark, d):
    return at_theta(spark, d).var_corr_df().select("grp", F.round("vcov", 5).alias("vcov"), F.round("sdcor", 6).alias("sdcor"))


@query("lmm_criteria", _sql("select m.name, round(m.v, 3) as value from (select 'reml' as name, ld + ln(det) + (n - 2) * (1 + ln(2 * pi() * r2 / (n - 2))) as v from s union all select 'ml', ld + n * (1 + ln(2 * pi() * r2 / n)) from s union all select 'aic', ld + n * (1 + ln(2 * pi() * r2 / n)) + 8 from s union all select 'bic', ld + n * (1 + ln(2 * pi() * r2 / n)) + 4 * ln(n) from s) m"))
def lmm_criteria(spark, d):
    r, m = at_theta(spark, d), at_theta(spark, d, reml=False)
    return spark.createDataFrame([("reml", r.deviance()), ("ml", m.deviance()), ("aic", m.aic()), ("bic", m.bic())], "name string, value double").select("name", F.round("value", 3).alias("value"))


_GRID = (0.0, 0.1, 0.3, 0.5, 0.9, 1.5)


def _grid_sql(reml: bool) -> str:
    part = "ld + ln(det) + (n - 2) * (1 + ln(2 * pi() * r2 / (n - 2)))" if reml else "ld + n * (1 + ln(2 * pi() * r2 / n))"
    return " union all ".join(f"select * from ({_sql(f'select {t}::double as theta, round({part}, 3) as deviance from s', t)})" for t in _GRID)


def _grid(spark, d, reml):
    m = at_theta(spark, d)
    return spark.createDataFrame([(t, pls.deviance(m.spec, m.gram, np.array([t]), reml)) for t in _GRID], "theta double, deviance double").select("theta", F.round("deviance", 3).alias("deviance"))


@query("reml_grid", _grid_sql(True))
def reml_grid(spark, d):
    return _grid(spark, d, True)


@query("ml_deviance_grid", _grid_sql(False))
def ml_deviance_grid(spark, d):
    return _grid(spark, d, False)


@query("fixed_sigma_deviance", _sql("select round(ld + n * (ln(2 * pi()) + 2 * ln(3.0::double)) + r2 / 9, 3) as deviance from s"))
def fixed_sigma_deviance(spark, d):
    m = at_theta(spark, d)
    return spark.createDataFrame([(round(pls.deviance(m.spec, m.gram, m.theta, False, sigma=3.0), 3),)], "deviance double")


_ROW = "select t.l_orderkey, t.l_linenumber, t.l_suppkey, b0 + b1 * t.x + k * (j.sy - j.n * b0 - j.sx * b1) as fit, t.y, t.x, k, j.n as nj, j.sx as sxj, sigma, a11, a12, a22, det from t join j on t.g = j.g, s"


@query("lmm_fitted", _sql(f"select l_orderkey, l_linenumber, round(fit, 4) + 0.0 as fitted, round(y - fit, 4) + 0.0 as resid, round((y - fit) / sigma, 4) + 0.0 as scaled_resid from ({_ROW})"))
def lmm_fitted(spark, d):
    return at_theta(spark, d).fitted().select("l_orderkey", "l_linenumber", *((F.round(c, 4) + 0.0).alias(c) for c in ("fitted", "resid", "scaled_resid")))


_HAT = f"select *, k + ((1 - k * nj) * (1 - k * nj) * a22 - 2 * (1 - k * nj) * (x - k * sxj) * a12 + (x - k * sxj) * (x - k * sxj) * a11) / det as h from ({_ROW})"


@query("lmm_hat", _sql(f"select l_orderkey, l_linenumber, round(h, 7) as hat, round((y - fit) / sigma / sqrt(1 - h), 4) + 0.0 as rstudent, round(pow((y - fit) / (1 - h), 2) * h / (2 * sigma * sigma), 6) as cooks from ({_HAT})"))
def lmm_hat(spark, d):
    return at_theta(spark, d).hat().select("l_orderkey", "l_linenumber", F.round("hat", 7).alias("hat"), (F.round("rstudent", 4) + 0.0).alias("rstudent"), F.round("cooks", 6).alias("cooks"))


@query("anova_sequential", _sql("select 'l_quantity' as term, 1 as npar, round(det / a11 * b1 * b1, 5) as sum_sq, round(det / a11 * b1 * b1 / (sigma * sigma), 4) as f_value from s"))
def anova_sequential(spark, d):
    return at_theta(spark, d).anova_terms().select("term", "npar", F.round("sum_sq", 5).alias("sum_sq"), F.round("f_value", 4).alias("f_value"))


@query("ranef_intervals", _sql("select g::varchar as grp, round(k * (j.sy - j.n * b0 - j.sx * b1) - 1.959963984540054 * sigma * sqrt(k), 5) as lower, round(k * (j.sy - j.n * b0 - j.sx * b1) + 1.959963984540054 * sigma * sqrt(k), 5) as upper from j, s"))
def ranef_intervals(spark, d):
    return at_theta(spark, d).ranef_intervals().select("grp", F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


@query("residual_plot_data", _sql(f"select l_orderkey, l_linenumber, round(fit, 4) + 0.0 as fitted, abs((y - fit) / sigma) > 1.959963984540054 as flagged from ({_ROW})"))
def residual_plot_data(spark, d):
    return at_theta(spark, d).plot_data().select("l_orderkey", "l_linenumber", (F.round("fitted", 4) + 0.0).alias("fitted"), "flagged")


@query("re_pca", f"select 'l_suppkey' as grp, 1 as component, {THETA}::double as sdev, 1.0::double as share")
def re_pca(spark, d):
    return at_theta(spark, d).re_pca()


@query("all_fit")
def all_fit(spark, d):
    return lmm.all_fit(lmm.fit_lmm(lines(spark, d), FORMULA))


@query("scaled_resid_quantiles", _sql(f"select round(quantile_cont((y - fit) / sigma, 0.0), 5) as q0, round(quantile_cont((y - fit) / sigma, 0.25), 5) as q1, round(quantile_cont((y - fit) / sigma, 0.5), 5) as q2, round(quantile_cont((y - fit) / sigma, 0.75), 5) as q3, round(quantile_cont((y - fit) / sigma, 1.0), 5) as q4 from ({_ROW})"))
def scaled_resid_quantiles(spark, d):
    return at_theta(spark, d).scaled_quantiles().select(*(F.round(f"q{i}", 5).alias(f"q{i}") for i in range(5)))


@query("predict_new_levels", _sql("select v.k2 as l_suppkey, round(b0 + b1 * 10 + coalesce(k * (j.sy - j.n * b0 - j.sx * b1), 0), 5) as pred from (select unnest([-1, 0, 1, 2, 3]) as k2) v left join j on j.g = v.k2, s"))
def predict_new_levels(spark, d):
    new = spark.createDataFrame([(k, 10.0) for k in (-1, 0, 1, 2, 3)], "l_suppkey int, l_quantity double")
    return at_theta(spark, d).predict(new, allow_new=True).select("l_suppkey", F.round("pred", 5).alias("pred"))


@query("predict_population", _sql("select l_orderkey, l_linenumber, round(b0 + b1 * x, 5) as pred from t, s"))
def predict_population(spark, d):
    return at_theta(spark, d).predict(lines(spark, d), re_form=None).select("l_orderkey", "l_linenumber", F.round("pred", 5).alias("pred"))


@query("new_level_detect", "select 'l_suppkey' as factor, l_suppkey::varchar as level from (select distinct l_suppkey from lineitem where l_quantity < 3) where l_suppkey not in (select l_suppkey from lineitem where l_linenumber = 1)")
def new_level_detect(spark, d):
    t = lines(spark, d)
    return at_theta(spark, d, frame=t.where("l_linenumber = 1")).new_levels(t.where("l_quantity < 3"))


@query("confint_wald", _sql("select '(Intercept)' as term, round(b0 - 1.959963984540054 * sigma * sqrt(a22 / det), 5) as lower, round(b0 + 1.959963984540054 * sigma * sqrt(a22 / det), 5) as upper from s union all select 'l_quantity', round(b1 - 1.959963984540054 * sigma * sqrt(a11 / det), 5), round(b1 + 1.959963984540054 * sigma * sqrt(a11 / det), 5) from s"))
def confint_wald(spark, d):
    return at_theta(spark, d).confint().select("term", F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


@query("lmm_reml_intercept")
def lmm_reml_intercept(spark, d):
    m = lmm.fit_lmm(lines(spark, d), "y ~ 1 + (1 | l_suppkey)")
    return spark.createDataFrame([(round(m.fixef()["(Intercept)"], 5), round(m.sigma, 5), round(float(m.theta[0]), 5))], "intercept double, sigma double, theta double")


@query("theta_start", f"with {_T}, v as (select y, avg(y) over (partition by g) as m from t) select round(sqrt(var_samp(m) / (var_samp(y) - var_samp(m))), 6) as theta0 from v")
def theta_start(spark, d):
    m = at_theta(spark, d)
    return spark.createDataFrame([(float(lmm.moment_start(m.spec, m.gram)[0]),)], "theta0 double").select(F.round("theta0", 6).alias("theta0"))


@query("nlevels_check", "select count(*) as n, count(distinct l_suppkey) as n_supp, count(distinct l_suppkey) >= 2 as ok from lineitem")
def nlevels_check(spark, d):
    spec = design.compile_model(lines(spark, d), FORMULA)
    design.check(spec)
    return spark.createDataFrame([(spec.n, spec.n_levels["l_suppkey"], spec.n_levels["l_suppkey"] >= 2)], "n bigint, n_supp bigint, ok boolean")


@query("is_nested", "select 'orders in customers' as name, not exists (select 1 from orders group by o_orderkey having count(distinct o_custkey) > 1) as nested union all select 'parts in suppliers', not exists (select 1 from lineitem group by l_partkey having count(distinct l_suppkey) > 1)")
def is_nested(spark, d):
    a = design.is_nested(read_table(spark, d, "orders"), "o_orderkey", "o_custkey")
    b = design.is_nested(read_table(spark, d, "lineitem"), "l_partkey", "l_suppkey")
    return spark.createDataFrame([("orders in customers", a), ("parts in suppliers", b)], "name string, nested boolean")


@query("interaction_levels", "select l_returnflag || ':' || l_linestatus as level, row_number() over (order by l_returnflag, l_linestatus) as idx from (select distinct l_returnflag, l_linestatus from lineitem)")
def interaction_levels(spark, d):
    return design.interaction(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("dummy_columns", "select l_orderkey, l_linenumber, case when l_returnflag = 'N' then 1.0::double else 0 end as l_returnflag_N, case when l_returnflag = 'R' then 1.0::double else 0 end as l_returnflag_R from lineitem")
def dummy_columns(spark, d):
    return design.dummy(read_table(spark, d, "lineitem"), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag_N", "l_returnflag_R")


@query("na_omit_frame", "select o_orderkey, nullif(o_totalprice, 0) as y from orders where nullif(o_orderpriority, '1-URGENT') is not null")
def na_omit_frame(spark, d):
    t = read_table(spark, d, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return design.compile_model(t, "o_totalprice ~ p + (1 | o_custkey)").frame.select("o_orderkey", F.col("_y").alias("y"))


@query("scale_x", "select round(avg(l_quantity), 6) as center, round(stddev_samp(l_quantity), 6) as scale from lineitem")
def scale_x(spark, d):
    spec = lmm.compile_lmm(lines(spark, d), FORMULA)
    lmm.sums_of(spec, Control(autoscale=True))
    return spark.createDataFrame(list(spec.scale.values()), "center double, scale double").select(F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


_LML = f"with {_T}, f as (select g as grp, count(*) as n, regr_intercept(y, x) as intercept, regr_slope(y, x) as slope, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) as rss from t group by g)"


@query("lmlist_coef", _LML + " select grp, n, round(intercept, 6) as intercept, round(slope, 6) as slope from f")
def lmlist_coef(spark, d):
    return lmlist.lm_list(lines(spark, d), "y", "l_quantity", "l_suppkey").select("grp", "n", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"))


@query("lmlist_pooled_sd", _LML + " select round(sqrt(sum(rss) / sum(n - 2)), 6) as sd, sum(n - 2)::bigint as df from f")
def lmlist_pooled_sd(spark, d):
    return lmlist.pooled_sd(lmlist.lm_list(lines(spark, d), "y", "l_quantity", "l_suppkey")).select(F.round("sd", 6).alias("sd"), "df")


@query("lmlist_ranef", _LML + " select grp, round(intercept - (select avg(intercept) from f), 6) as intercept, round(slope - (select avg(slope) from f), 6) as slope from f")
def lmlist_ranef(spark, d):
    r = lmlist.ranef(lmlist.lm_list(lines(spark, d), "y", "l_quantity", "l_suppkey"))
    return r.select("grp", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"))


@query("lmlist_residuals", _LML + " select l_orderkey, l_linenumber, round(y - intercept - slope * x, 5) as resid from t join f on t.g = f.grp")
def lmlist_residuals(spark, d):
    t = lines(spark, d)
    return lmlist.residuals(t, lmlist.lm_list(t, "y", "l_quantity", "l_suppkey"), "y", "l_quantity", "l_suppkey").select("l_orderkey", "l_linenumber", F.round("resid", 5).alias("resid"))


_DEV = {
    "binomial": ("l_discount * 5", "l_tax * 5 + 0.3", "2 * l_quantity * ((case when y = 0 then 0 else y * ln(y / m) end) + (case when y = 1 then 0 else (1 - y) * ln((1 - y) / (1 - m)) end))"),
    "poisson": ("l_linenumber - 1", "l_quantity / 10 + 0.5", "2 * l_quantity * ((case when y = 0 then 0 else y * ln(y / m) end) - (y - m))"),
    "Gamma": ("l_quantity", "l_linenumber * 5", "-2 * l_quantity * (ln(y / m) - (y - m) / m)"),
    "gaussian": ("l_quantity", "l_linenumber * 5", "l_quantity * (y - m) * (y - m)"),
    "inverse.gaussian": ("l_quantity", "l_linenumber * 5", "l_quantity * (y - m) * (y - m) / (y * m * m)"),
    "negative.binomial": ("l_linenumber - 1", "l_quantity / 10 + 0.5", "2 * l_quantity * ((case when y = 0 then 0 else y * ln(y / m) end) - (y + 1) * ln((y + 1) / (m + 1)))"),
}


def _family_query(name: str, y: str, mu: str, sql: str) -> None:
    @query(f"family_{name.replace('.', '_').lower()}_devresid", f"select l_orderkey, l_linenumber, round({sql}, 5) + 0.0 as dev from (select *, ({y})::double as y, ({mu})::double as m from lineitem)")
    def run(spark, d):
        t = read_table(spark, d, "lineitem").withColumn("y", F.expr(y).cast("double")).withColumn("m", F.expr(mu).cast("double"))
        return t.select("l_orderkey", "l_linenumber", (F.round(family.dev_resid(name, F.col("y"), F.col("m"), F.col("l_quantity")), 5) + 0.0).alias("dev"))


for _n, (_y, _m, _s) in _DEV.items():
    _family_query(_n, _y, _m, _s)

_LINKS = {
    "identity": ("e", "1.0::double"),
    "log": ("greatest(exp(e), 2.220446049250313e-16)", "greatest(exp(e), 2.220446049250313e-16)"),
    "logit": ("least(1 - 2.220446049250313e-16, greatest(2.220446049250313e-16, 1 / (1 + exp(-e))))", "greatest(2.220446049250313e-16, 1 / (1 + exp(-e)) * (1 - 1 / (1 + exp(-e))))"),
    "cloglog": ("greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, 1 - exp(-exp(e))))", "greatest(2.220446049250313e-16, exp(e - exp(e)))"),
    "cauchit": ("least(1 - 2.220446049250313e-16, 0.5 + atan(e) / pi())", "1 / (pi() * (1 + e * e))"),
    "inverse": ("1 / e", "-1 / (e * e)"),
}


def _link_query(name: str, inv: str, slope: str) -> None:
    @query(f"link_{name}", f"select l_orderkey, l_linenumber, round({inv}, 8) as mu, round({slope}, 8) as mu_eta from (select *, (l_quantity - 25.25::double) / 10 as e from lineitem)")
    def run(spark, d):
        t = read_table(spark, d, "lineitem").withColumn("e", (F.col("l_quantity") - F.lit(25.25)) / 10)
        return t.select("l_orderkey", "l_linenumber", F.round(family.link_inverse(name, F.col("e")), 8).alias("mu"), F.round(family.mu_eta(name, F.col("e")), 8).alias("mu_eta"))


for _n, (_i, _m) in _LINKS.items():
    _link_query(_n, _i, _m)


@query("working_response", "select l_orderkey, l_linenumber, round(exp(e), 6) as mu, round(exp(e), 6) as variance, round((l_linenumber - exp(e)) / exp(e), 6) + 0.0 as wrk_resid, round(e + (l_linenumber - exp(e)) / exp(e), 6) as wrk_resp, round(sqrt(exp(e)), 6) as sqrt_wrk_wt, round(sqrt(exp(e)) * (e + (l_linenumber - exp(e)) / exp(e)), 5) as wt_wrk_resp from (select *, l_quantity / 25.0::double as e from lineitem)")
def working_response(spark, d):
    t = family.working_columns(read_table(spark, d, "lineitem").withColumn("e", F.col("l_quantity") / 25), "poisson", "log", "l_linenumber", "e")
    return t.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("mu", "variance")), (F.round("wrk_resid", 6) + 0.0).alias("wrk_resid"), *(F.round(c, 6).alias(c) for c in ("wrk_resp", "sqrt_wrk_wt")), F.round("wt_wrk_resp", 5).alias("wt_wrk_resp"))


@query("cov_cs_lambda", "select i, j, round((case when i = j then 1.0::double else 0.3 end) * i * j, 6) as v from (select unnest([1, 2, 3]) as i), (select unnest([1, 2, 3]) as j)")
def cov_cs_lambda(spark, d):
    m = covstruct.make("cs", 3).factor(np.array([1.0, 2.0, 3.0, 0.3]))
    v = m @ m.T
    return spark.createDataFrame([(i + 1, j + 1, round(float(v[i, j]), 6)) for i in range(3) for j in range(3)], "i int, j int, v double")


@query("cov_ar1_lambda", "select i, j, round(4 * pow(0.6::double, abs(i - j)), 6) as v from (select unnest([1, 2, 3, 4]) as i), (select unnest([1, 2, 3, 4]) as j)")
def cov_ar1_lambda(spark, d):
    m = covstruct.make("ar1", 4).factor(np.array([2.0, 0.6]))
    v = m @ m.T
    return spark.createDataFrame([(i + 1, j + 1, round(float(v[i, j]), 6)) for i in range(4) for j in range(4)], "i int, j int, v double")


@query("expand_grid", "select a, b, r from (select unnest(['a1', 'a2', 'a3']) as a), (select unnest(['b1', 'b2']) as b), (select unnest([1, 2]) as r)")
def expand_grid(spark, d):
    return design.expand_grid(spark, a=["a1", "a2", "a3"], b=["b1", "b2"], r=[1, 2])


@query("lmm_reml_fit")
def lmm_reml_fit(spark, d):
    return flagship(spark, d)


@query("lmm_vector_fit")
def lmm_vector_fit(spark, d):
    return lmm.fit_lmm(lines(spark, d), "y ~ l_quantity + l_returnflag + (l_quantity | l_suppkey)").var_corr_df()


@query("lmm_crossed_fit")
def lmm_crossed_fit(spark, d):
    t = lines(spark, d).withColumn("k", F.expr("l_partkey % 7")).withColumn("y", F.col("y") + F.cos("k"))
    return lmm.fit_lmm(t, "y ~ l_quantity + (1 | l_suppkey) + (1 | k)").var_corr_df()


@query("anova_lrt")
def anova_lrt(spark, d):
    t = lines(spark, d)
    return lmm.anova([lmm.fit_lmm(t, f) for f in ("y ~ 1 + (1 | l_suppkey)", "y ~ l_quantity + (1 | l_suppkey)")])


@query("simulate_gaussian")
def simulate_gaussian(spark, d):
    return at_theta(spark, d).simulate(2).select("l_orderkey", "l_linenumber", "sim_id", "sim")


@query("influence_groups")
def influence_groups(spark, d):
    return at_theta(spark, d).influence()


@query("glmm_binomial")
def glmm_binomial(spark, d):
    from mixloom.operators.glmm import fit_glmm

    t = read_table(spark, d, "labels").join(read_table(spark, d, "documents"), "doc_id")
    return fit_glmm(t, "quality ~ 1 + (1 | source)", "binomial").ranef()


@query("glmm_poisson")
def glmm_poisson(spark, d):
    from mixloom.operators.glmm import fit_glmm

    t = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = fit_glmm(t, "n ~ event_type + (1 | user_id)", "poisson", n_agq=0)
    return spark.createDataFrame([*m.fixef().items(), ("theta", float(m.theta[0])), ("deviance", float(m.deviance))], "term string, value double")


@query("glmm_predict_errors")
def glmm_predict_errors(spark, d):
    from mixloom.operators.glmm import fit_glmm

    t = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return fit_glmm(t, "n ~ event_type + (1 | user_id)", "poisson", n_agq=0).predict(t, kind="response", se_fit=True)


# -- weights, offsets, factors, ranks: the same model with more in it ---------------------------------
def _weighted(body: str, theta: float = THETA, w: str = "l_linenumber - 1", o: str = "l_tax") -> str:
    """As _sql, with weights (rows of weight zero are out) and an offset."""
    t = theta * theta
    return f"""with t as (select l_extendedprice / 10000.0::double + 2 * sin(l_suppkey) - ({o}) as y, l_quantity as x, l_suppkey as g, ({w})::double as w, * from lineitem where ({w}) > 0),
j as (select g, sum(w) as n, sum(w * x) as sx, sum(w * y) as sy, {t}::double / (1 + {t}::double * sum(w)) as k, ln(1 + {t}::double * sum(w)) as ld from t group by g),
w as (select count(*)::double as rows_, sum(w) as n, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy, sum(w * y * y) as syy, sum(ln(w)) as lw from t),
a as (select w.rows_ as rows_, w.lw as lw, w.n - sum(k * j.n * j.n) as a11, w.sx - sum(k * j.n * j.sx) as a12, w.sxx - sum(k * j.sx * j.sx) as a22, w.sy - sum(k * j.n * j.sy) as c1, w.sxy - sum(k * j.sx * j.sy) as c2, w.syy - sum(k * j.sy * j.sy) as r0, sum(ld) as ld from j, w group by w.rows_, w.lw, w.n, w.sx, w.sy, w.sxx, w.sxy, w.syy),
b as (select *, a11 * a22 - a12 * a12 as det from a),
c as (select *, (a22 * c1 - a12 * c2) / det as b0, (a11 * c2 - a12 * c1) / det as b1 from b),
s as (select *, r0 - b0 * c1 - b1 * c2 as r2, sqrt((r0 - b0 * c1 - b1 * c2) / (rows_ - 2)) as sigma from c)
{body}"""


def weighted(spark, d, reml=True):
    return at_theta(spark, d, reml, weights="l_linenumber - 1", offset="l_tax")


@query("weighted_fixef", _weighted("select '(Intercept)' as term, round(b0, 6) as estimate, round(sigma * sqrt(a22 / det), 6) as std_error from s union all select 'l_quantity', round(b1, 6), round(sigma * sqrt(a11 / det), 6) from s"))
def weighted_fixef(spark, d):
    return weighted(spark, d).coef_table().select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query("weighted_criteria", _weighted("select round(ld + ln(det) - lw + (rows_ - 2) * (1 + ln(2 * pi() * r2 / (rows_ - 2))), 3) as reml, round(ld - lw + rows_ * (1 + ln(2 * pi() * r2 / rows_)), 3) as ml, rows_::bigint as n from s"))
def weighted_criteria(spark, d):
    m = weighted(spark, d)
    return spark.createDataFrame([(round(m.deviance(True), 3), round(m.deviance(False), 3), m.n)], "reml double, ml double, n bigint")


@query("weighted_ranef", _weighted("select g::varchar as grp, round(k * (j.sy - j.n * b0 - j.sx * b1), 5) as condval, round(sigma * sqrt(k), 6) as condsd from j, s"))
def weighted_ranef(spark, d):
    return weighted(spark, d).ranef().select("grp", F.round("condval", 5).alias("condval"), F.round("condsd", 6).alias("condsd"))


@query("residual_types", _weighted("select l_orderkey, l_linenumber, round(y - b0 - b1 * x - k * (j.sy - j.n * b0 - j.sx * b1), 4) + 0.0 as response, round(sqrt(w) * (y - b0 - b1 * x - k * (j.sy - j.n * b0 - j.sx * b1)) / sigma, 4) + 0.0 as scaled_pearson from t join j on t.g = j.g, s"))
def residual_types(spark, d):
    m = weighted(spark, d)
    r = m.residuals("pearson", scaled=True).where("_w > 0")
    return r.select("l_orderkey", "l_linenumber", (F.round("resid", 4) + 0.0).alias("response"), (F.round("residual", 4) + 0.0).alias("scaled_pearson"))


@query("autoscaled_fixef", ORACLES["lmm_fixef"])
def autoscaled_fixef(spark, d):
    return at_theta(spark, d, control=Control(autoscale=True)).coef_table().select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query("rank_drop", _sql("select '(Intercept)' as term, round(b0, 6) as estimate, false as dropped from s union all select 'l_quantity', round(b1, 6), false from s union all select '2 * l_quantity', null, true"))
def rank_drop(spark, d):
    m = at_theta(spark, d, formula="y ~ l_quantity + I(2*l_quantity) + (1 | l_suppkey)")
    rows = [(n, None if v != v else round(v, 6), n in m.spec.dropped) for n, v in m.fixef(add_dropped=True).items()]
    return spark.createDataFrame(rows, "term string, estimate double, dropped boolean")


_FLAG = f"with {_T}, m as (select l_returnflag as f, avg(y) as m from t group by l_returnflag)"


@query("predict_factor", _FLAG + " select l_orderkey, l_linenumber, round(m, 5) as pred from t join m on m.f = t.l_returnflag where l_returnflag in ('N', 'R') and l_linenumber = 2")
def predict_factor(spark, d):
    """Trained on all levels, asked about two of them: the levels are those of the fit."""
    m = at_theta(spark, d, theta=0.0, formula="y ~ l_returnflag + (1 | l_suppkey)")
    new = lines(spark, d).where("l_returnflag in ('N', 'R') and l_linenumber = 2")
    return m.predict(new).select("l_orderkey", "l_linenumber", F.round("pred", 5).alias("pred"))


@query("predict_nulls", _sql("select l_orderkey, l_linenumber, case when l_linenumber <> 3 then round(b0 + b1 * x, 5) end as pred from t, s"))
def predict_nulls(spark, d):
    """Rows that lack a variable stay, without a prediction."""
    new = lines(spark, d).withColumn("l_quantity", F.expr("case when l_linenumber <> 3 then l_quantity end"))
    return at_theta(spark, d).predict(new, re_form=None).select("l_orderkey", "l_linenumber", F.round("pred", 5).alias("pred"))


@query("predict_se", _sql(f"select l_orderkey, l_linenumber, round(fit, 4) as pred, round(sigma * sqrt(h), 6) as se from ({_HAT})"))
def predict_se(spark, d):
    return at_theta(spark, d).predict(lines(spark, d), se_fit=True).select("l_orderkey", "l_linenumber", F.round("pred", 4).alias("pred"), F.round("se", 6).alias("se"))


@query("predict_se_population", _sql("select l_orderkey, l_linenumber, round(sigma * sqrt((a22 - 2 * x * a12 + x * x * a11) / det), 6) as se from t, s"))
def predict_se_population(spark, d):
    return at_theta(spark, d).predict(lines(spark, d), re_form=None, se_fit=True).select("l_orderkey", "l_linenumber", F.round("se", 6).alias("se"))


@query("predict_random_only", _sql("select l_orderkey, l_linenumber, round(k * (j.sy - j.n * b0 - j.sx * b1), 5) as pred from t join j on t.g = j.g, s"))
def predict_random_only(spark, d):
    return at_theta(spark, d).predict(lines(spark, d), random_only=True).select("l_orderkey", "l_linenumber", F.round("pred", 5).alias("pred"))


@query("fitted_na_exclude", "with t as (select l_extendedprice / 10000.0::double + 2 * sin(l_suppkey) as y, l_suppkey as g, * from lineitem), m as (select avg(y) as m from t where l_linenumber <> 3) select l_orderkey, l_linenumber, case when l_linenumber <> 3 then round(m, 5) end as fitted from t, m")
def fitted_na_exclude(spark, d):
    t = lines(spark, d).withColumn("y", F.expr("case when l_linenumber <> 3 then y end"))
    return at_theta(spark, d, theta=0.0, formula="y ~ 1 + (1 | l_suppkey)", frame=t, na_action="exclude").fitted().select("l_orderkey", "l_linenumber", F.round("fitted", 5).alias("fitted"))


@query("simulate_means", ORACLES["lmm_fitted"].replace("round(fit, 4) + 0.0 as fitted, round(y - fit, 4) + 0.0 as resid, round((y - fit) / sigma, 4) + 0.0 as scaled_resid", "1 as sim_id, round(fit, 4) + 0.0 as sim"))
def simulate_means(spark, d):
    """Simulation around the modes without noise."""
    return at_theta(spark, d).simulate(1, use_u=True, mean_only=True, key=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "sim_id", (F.round("sim", 4) + 0.0).alias("sim"))


@query("simulate_distinct", "select 2 * count(*) as n, 2 * count(*) as n_distinct from lineitem where l_linenumber < 3")
def simulate_distinct(spark, d):
    """Rows that agree in every column draw apart, and so do replicates."""
    t = lines(spark, d).where("l_linenumber < 3").select("l_suppkey", F.lit(1.0).alias("y"), F.lit(2.0).alias("l_quantity"))
    m = at_theta(spark, d)
    return m.simulate(2, newdata=t).agg(F.count("sim").alias("n"), F.countDistinct("sim").alias("n_distinct"))


@query("ranef_order", _sql("select g::varchar as grp, row_number() over (order by k * (j.sy - j.n * b0 - j.sx * b1)) as ord from j, s"))
def ranef_order(spark, d):
    return at_theta(spark, d).ranef_df().select("grp", F.col("ord").cast("long").alias("ord"))


@query("coef_order", _sql("select g::varchar as grp, row_number() over (order by k * (j.sy - j.n * b0 - j.sx * b1)) as ord from j, s"))
def coef_order(spark, d):
    return plotdata.coef_points(at_theta(spark, d)).where("term = '(Intercept)'").select("grp", F.col("ord").cast("long").alias("ord"))


@query("residual_scores", _sql(f"select row_number() over (order by (y - fit) / sigma) as rank, round((y - fit) / sigma, 4) + 0.0 as value from ({_ROW})"))
def residual_scores(spark, d):
    return plotdata.residual_scores(at_theta(spark, d)).select(F.col("rank").cast("long").alias("rank"), (F.round("scaled_resid", 4) + 0.0).alias("value"))


@query("id_labels", "select o_orderkey, o_custkey::varchar || '/' || o_orderstatus as label from orders")
def id_labels(spark, d):
    return plotdata.id_labels(read_table(spark, d, "orders"), "o_custkey", "o_orderstatus").select("o_orderkey", "label")


@query("model_matrix_fixed", "select l_orderkey, l_linenumber, 1.0::double as one, l_quantity as q, case l_returnflag when 'A' then 1.0::double when 'R' then -1 else 0 end as f1, case l_returnflag when 'N' then 1.0::double when 'R' then -1 else 0 end as f2, l_quantity * case l_returnflag when 'A' then 1.0::double when 'R' then -1 else 0 end as qf1 from lineitem")
def model_matrix_fixed(spark, d):
    spec = design.compile_model(lines(spark, d), "y ~ l_quantity * l_returnflag + (1 | l_suppkey)", contrasts={"l_returnflag": "sum"})
    x = dict(zip(spec.x_names, spec.x_cols, strict=True))
    return spec.frame.select("l_orderkey", "l_linenumber", *(F.col(x[n]).alias(a) for n, a in (("(Intercept)", "one"), ("l_quantity", "q"), ("l_returnflag1", "f1"), ("l_returnflag2", "f2"), ("l_quantity:l_returnflag1", "qf1"))))


@query("model_matrix_random", "select 'l_suppkey' as term, l_suppkey::varchar as grp, e as effect, count(*) as n, round(sum(case when e = 'l_quantity' then l_quantity else 1 end), 3) as total from lineitem, (select unnest(['(Intercept)', 'l_quantity']) as e) group by all")
def model_matrix_random(spark, d):
    z = design.model_matrix(design.compile_model(lines(spark, d), "y ~ 1 + (l_quantity | l_suppkey)"), "random")
    return z.groupBy("term", "grp", "effect").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("data_template", "select 'a' || a as a, 'b' || b as b, 3 as n from (select unnest([1, 2, 3, 4]) as a), (select unnest([1, 2]) as b)")
def data_template(spark, d):
    return design.data_template(spark, "y ~ x + (1 | a) + (1 | b)", {"a": 4, "b": 2}, 3).groupBy("a", "b").agg(F.count("x").cast("int").alias("n"))


@query("group_keys", "select count(distinct (l_returnflag, l_linestatus)) as n from lineitem")
def group_keys(spark, d):
    """Levels of an interaction are told apart even where their parts hold the sign that joins them."""
    t = read_table(spark, d, "lineitem").select(F.concat("l_returnflag", F.lit(":")).alias("a"), F.concat(F.lit(":"), "l_linestatus").alias("b"))
    return t.select(design.group_key("a", "b").alias("k")).agg(F.countDistinct("k").alias("n"))


# -- generalized models at theta 0, where they are plain regressions ---------------------------------
def glm_at_zero(spark, frame, formula, name, link=None, weights=None):
    f = family.Family(name, link or glmm.DEFAULT_LINK[name])
    spec, c = glmm.compile_glmm(frame, formula, weights)
    zero = np.zeros(sum(t.structure.n_par for t in spec.terms))
    value, beta, u = glmm.laplace(c, f, glmm._templates(spec, c, zero), glmm.begin(c, f), np.zeros(c.q), True)
    return glmm.GLMM(spec, f, zero, beta, u, value, c, 1, call=lmm.Call(frame, formula, {}))


_POIS = "with t as (select *, l_linenumber::double as y from lineitem), m as (select avg(y) as mu, count(*) as n from t)"


_KINDS = {"deviance": "sign(y - mu) * sqrt(greatest(0, 2 * (y * ln(y / mu) - (y - mu))))", "pearson": "(y - mu) / sqrt(mu)", "working": "(y - mu) / mu", "response": "y - mu"}


@query("glmm_residual_types", _POIS + " " + " union all ".join(f"select l_orderkey, l_linenumber, '{k}' as kind, round({v}, 5) + 0.0 as residual from t, m" for k, v in _KINDS.items()))
def glmm_residual_types(spark, d):
    m = glm_at_zero(spark, read_table(spark, d, "lineitem"), "l_linenumber ~ 1 + (1 | l_suppkey)", "poisson")
    parts = [m.residuals(k).select("l_orderkey", "l_linenumber", F.lit(k).alias("kind"), (F.round("residual", 5) + 0.0).alias("residual")) for k in _KINDS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("glmm_loglik", _POIS + " select round(-2 * sum(y * ln(mu) - mu - lgamma(y + 1)), 2) as deviance, round(-2 * sum(y * ln(mu) - mu - lgamma(y + 1)) + 4, 2) as aic from t, m")
def glmm_loglik(spark, d):
    m = glm_at_zero(spark, read_table(spark, d, "lineitem"), "l_linenumber ~ 1 + (1 | l_suppkey)", "poisson")
    return spark.createDataFrame([(round(m.deviance, 2), round(m.aic(), 2))], "deviance double, aic double")


@query("glmm_coef_table", _POIS + ", v as (select mu, n, ln(mu) / sqrt(1 / (n * mu)) as z from m) select '(Intercept)' as term, round(ln(mu), 6) as estimate, round(sqrt(1 / (n * mu)), 7) as std_error, round(z, 3) as z_value from v")
def glmm_coef_table(spark, d):
    m = glm_at_zero(spark, read_table(spark, d, "lineitem"), "l_linenumber ~ 1 + (1 | l_suppkey)", "poisson")
    return m.coef_table().select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 7).alias("std_error"), F.round("z_value", 3).alias("z_value"))


@query("glmm_predict_response", "with m as (select l_returnflag as f, avg((l_linestatus = 'O')::int) as p from lineitem group by l_returnflag) select l_orderkey, l_linenumber, round(p, 5) as pred from lineitem join m on f = l_returnflag where l_returnflag = 'N'")
def glmm_predict_response(spark, d):
    t = read_table(spark, d, "lineitem").withColumn("z", (F.col("l_linestatus") == "O").cast("double"))
    m = glm_at_zero(spark, t, "z ~ l_returnflag + (1 | l_suppkey)", "binomial")
    return m.predict(t.where("l_returnflag = 'N'"), kind="response").select("l_orderkey", "l_linenumber", F.round("pred", 5).alias("pred"))


@query("gamma_shape", "with m as (select avg(l_quantity) as mu from lineitem), v as (select avg(-2 * (ln(l_quantity / mu) - (l_quantity - mu) / mu)) as dd from lineitem, m) select round((6 + 2 * dd) / (dd * (6 + dd)), 5) as shape from v")
def gamma_shape(spark, d):
    m = glm_at_zero(spark, read_table(spark, d, "lineitem"), "l_quantity ~ 1 + (1 | l_suppkey)", "Gamma", "log")
    return spark.createDataFrame([(round(m.gamma_shape(), 5),)], "shape double")


_SCALED = {
    "Gamma": "-2 * sum((a - 1) * ln(l_quantity) - l_quantity * a / mu - a * ln(mu / a) - lgamma(a)) + 2 from lineitem, (select mu, 1 / avg(-2 * (ln(l_quantity / mu) - (l_quantity - mu) / mu)) as a from lineitem, m group by mu)",
    "inverse.gaussian": "count(*) * (ln(2 * pi() * avg((l_quantity - mu) * (l_quantity - mu) / (l_quantity * mu * mu))) + 1) + 3 * sum(ln(l_quantity)) + 2 from lineitem, m",
    "gaussian": "count(*) * (ln(2 * pi() * avg((l_quantity - mu) * (l_quantity - mu))) + 1) + 2 from lineitem, m",
}


def _scaled_query(name: str, sql: str) -> None:
    @query(f"family_{name.replace('.', '_').lower()}_likelihood", f"with m as (select avg(l_quantity) as mu from lineitem) select round(({sql.partition(' from ')[0]}), 2) as deviance from {sql.partition(' from ')[2]}")
    def run(spark, d):
        m = glm_at_zero(spark, read_table(spark, d, "lineitem"), "l_quantity ~ 1 + (1 | l_suppkey)", name, "log")
        return spark.createDataFrame([(round(float(m.deviance), 2),)], "deviance double")


for _n, _s in _SCALED.items():
    _scaled_query(_n, _s)

_AIC = {
    "poisson": ("l_linenumber - 1", "l_quantity / 10 + 0.5", "-2 * l_quantity * (y * ln(m) - m - lgamma(y + 1))"),
    "binomial": ("round(l_tax * 10) / l_quantity", "l_discount * 5 + 0.2", "-2 * (lgamma(l_quantity + 1) - lgamma(round(y * l_quantity) + 1) - lgamma(l_quantity - round(y * l_quantity) + 1) + round(y * l_quantity) * ln(m) + (l_quantity - round(y * l_quantity)) * ln(1 - m))"),
    "negative.binomial": ("l_linenumber - 1", "l_quantity / 10 + 0.5", "-2 * l_quantity * (lgamma(y + 1) - lgamma(1.0::double) - lgamma(y + 1) + ln(1 / (1 + m)) + y * ln(m / (1 + m)))"),
}


def _aic_query(name: str, y: str, mu: str, sql: str) -> None:
    @query(f"family_{name.replace('.', '_').lower()}_aic", f"select l_orderkey, l_linenumber, round({sql}, 4) + 0.0 as aic from (select *, ({y})::double as y, ({mu})::double as m from lineitem)")
    def run(spark, d):
        t = read_table(spark, d, "lineitem").withColumn("y", F.expr(y).cast("double")).withColumn("m", F.expr(mu).cast("double"))
        return t.select("l_orderkey", "l_linenumber", (F.round(family.aic_term(name, F.col("y"), F.col("m"), F.col("l_quantity")), 4) + 0.0).alias("aic"))


for _n, (_y, _m, _s) in _AIC.items():
    _aic_query(_n, _y, _m, _s)

_FORWARD = {"log": "ln(m)", "logit": "ln(m / (1 - m))", "cloglog": "ln(-ln(1 - m))", "cauchit": "tan(pi() * (m - 0.5))", "inverse": "1 / m", "identity": "m"}


def _forward_query(name: str, sql: str) -> None:
    @query(f"linkfun_{name}", f"select l_orderkey, l_linenumber, round({sql}, 7) + 0.0 as eta from (select *, l_quantity / 60 as m from lineitem)")
    def run(spark, d):
        t = read_table(spark, d, "lineitem").withColumn("m", F.col("l_quantity") / 60)
        return t.select("l_orderkey", "l_linenumber", (F.round(family.link(name, F.col("m")), 7) + 0.0).alias("eta"))


for _n, _s in _FORWARD.items():
    _forward_query(_n, _s)


@query("link_probit")
def link_probit(spark, d):
    """There is no normal distribution function in SQL: tested against numpy."""
    t = read_table(spark, d, "lineitem").withColumn("e", (F.col("l_quantity") - F.lit(25.25)) / 10)
    return t.select("l_orderkey", "l_linenumber", family.link_inverse("probit", F.col("e")).alias("mu"), family.mu_eta("probit", F.col("e")).alias("mu_eta"))


# -- regressions by group --------------------------------------------------------------------------
@query("lmlist_factor", f"with {_T}, m as (select g::varchar as grp, avg(y) filter (l_returnflag = 'A') as a, avg(y) filter (l_returnflag = 'N') as n, avg(y) filter (l_returnflag = 'R') as r from t group by g) select grp, round(a, 6) as intercept, round(n - a, 6) as flag_n, round(r - a, 6) as flag_r from m")
def lmlist_factor(spark, d):
    c = lmlist.fit_lm_list(lines(spark, d), "y ~ l_returnflag | l_suppkey").coef()
    return c.select("grp", F.round("`(Intercept)`", 6).alias("intercept"), F.round("l_returnflagN", 6).alias("flag_n"), F.round("l_returnflagR", 6).alias("flag_r"))


@query("lmlist_glm", "select l_suppkey::varchar as grp, round(ln(avg(l_linenumber)), 6) as intercept, count(*) as n from lineitem group by l_suppkey")
def lmlist_glm(spark, d):
    t = lmlist.fit_lm_list(read_table(spark, d, "lineitem"), "l_linenumber ~ 1 | l_suppkey", "poisson").table
    return t.select("grp", F.round(F.col("coef")[0], 6).alias("intercept"), "n")


@query("lmlist_fitted", _LML + " select l_orderkey, l_linenumber, round(intercept + slope * x, 5) as fitted from t join f on t.g = f.grp")
def lmlist_fitted(spark, d):
    return lmlist.fit_lm_list(lines(spark, d), "y ~ l_quantity | l_suppkey").fitted().select("l_orderkey", "l_linenumber", F.round("fitted", 5).alias("fitted"))


@query("lmlist_summary", _LML + ", p as (select sqrt(sum(rss) / sum(n - 2)) as sd from f), q as (select g as grp, regr_sxx(y, x) as sxx from t group by g) select f.grp::varchar as grp, round(slope, 6) as estimate, round(sd / sqrt(sxx), 7) as std_error from f join q using (grp), p")
def lmlist_summary(spark, d):
    s = lmlist.fit_lm_list(lines(spark, d), "y ~ l_quantity | l_suppkey").summary().where("term = 'l_quantity'")
    return s.select("grp", F.round("estimate", 6).alias("estimate"), F.round("std_error", 7).alias("std_error"))


# -- fits and inference: iterative, tested by brute force -------------------------------------------
@query("drop1_terms")
def drop1_terms(spark, d):
    return lmm.drop1(lmm.fit_lmm(lines(spark, d), "y ~ l_quantity + l_returnflag + (1 | l_suppkey)"))


@query("profile_intervals")
def profile_intervals(spark, d):
    return lmm.fit_lmm(lines(spark, d), FORMULA).confint(method="profile")


@query("bootstrap_intervals")
def bootstrap_intervals(spark, d):
    return lmm.fit_lmm(lines(spark, d), FORMULA).confint(method="boot", nsim=20)


@query("case_deletion")
def case_deletion(spark, d):
    return at_theta(spark, d).influence("row").where("param = 'l_quantity'").select("value", "change", "se")


@query("glmm_crossed")
def glmm_crossed(spark, d):
    t = read_table(spark, d, "lineitem").withColumn("z", (F.col("l_linestatus") == "O").cast("double")).withColumn("k", F.expr("l_partkey % 7"))
    return glmm.fit_glmm(t, "z ~ 1 + (1 | l_suppkey) + (1 | k)", "binomial", n_agq=0).coef_table()


@query("glmm_nb")
def glmm_nb(spark, d):
    t = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = glmm.fit_glmm_nb(t, "n ~ event_type + (1 | user_id)")
    return spark.createDataFrame([*m.fixef().items(), ("theta", float(m.theta[0])), ("size", float(m.family.theta))], "term string, value double")


@query("nlmm_logistic")
def nlmm_logistic(spark, d):
    t = read_table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x")).withColumn("y", F.expr("(10 + sin(l_suppkey)) / (1 + exp((20 - x) / 6)) + 0.2 * cos(l_suppkey * x)"))
    m = nlmm.fit_nlmm(t, f"y ~ {nlmm.logistic_curve()} ~ (Asym | l_suppkey)", {"Asym": 9.0, "xmid": 18.0, "scal": 5.0}, n_agq=0)
    return spark.createDataFrame([*m.fixef().items(), ("theta", float(m.theta[0])), ("sigma", m.sigma)], "term string, value double")


# -- the sizes of published timings, on drawn data ---------------------------------------------------
def repeated_measures(spark) -> DataFrame:
    """18 groups of 10 days, intercepts and slopes by group."""
    t = design.expand_grid(spark, g=[f"s{i}" for i in range(18)], day=list(range(10)))
    return glmm.simulate_formula(t, "~ day + (day | g)", {"(Intercept)": 250.0, "day": 10.0}, [1.0, 0.02, 0.23], 25.0, seed=3).withColumnRenamed("sim", "y").coalesce(1)


@query("size180_profile")
def size180_profile(spark, d):
    return lmm.fit_lmm(repeated_measures(spark), "y ~ day + (day | g)").confint(method="profile")


@query("size180_bootstrap")
def size180_bootstrap(spark, d):
    return lmm.fit_lmm(repeated_measures(spark), "y ~ day + (day | g)").confint(method="boot", nsim=500)


def herds(spark) -> DataFrame:
    """15 herds at 4 periods, less 4 rows: 56 counts out of some ten."""
    t = design.expand_grid(spark, herd=[f"h{i}" for i in range(15)], period=["1", "2", "3", "4"]).withColumn("size", F.expr("2D + pmod(xxhash64(herd, period), 19)")).where("not (period = '4' and herd in ('h0', 'h1', 'h2', 'h3'))")
    return glmm.simulate_formula(t, "~ period + (1 | herd)", {"(Intercept)": -1.4, "period2": -1.0, "period3": -1.1, "period4": -1.6}, [0.64], family="binomial", weights="size", seed=5).withColumnRenamed("sim", "y").coalesce(1)


@query("size56_binomial_profile")
def size56_binomial_profile(spark, d):
    return glmm.fit_glmm(herds(spark), "y ~ period + (1 | herd)", "binomial", weights="size").profile_interval()


@query("size7584_binomial")
def size7584_binomial(spark, d):
    """316 persons by 24 items, four factors and their pairs."""
    t = design.expand_grid(spark, id=list(range(316)), item=list(range(24)))
    t = t.withColumns({"a": F.expr("(id % 21) / 10D"), "b": F.when(F.col("id") % 3 == 0, "m").otherwise("f"), "c": F.element_at(F.array(F.lit("u"), F.lit("v"), F.lit("w")), F.col("item") % 3 + 1), "e": F.when(F.col("item") % 2 == 0, "x").otherwise("y")})
    names = design.compile_model(t.withColumn("_y", F.lit(1.0)), "_y ~ (a + b + c + e)^2 + (1 | id)").x_names
    beta = {n: 0.3 * (-1) ** k / (1 + k % 3) for k, n in enumerate(names)}
    y = glmm.simulate_formula(t, "~ (a + b + c + e)^2 + (1 | id) + (1 | item)", beta, [1.3, 0.5], family="binomial", seed=7).withColumnRenamed("sim", "y")
    return glmm.fit_glmm(y, "y ~ (a + b + c + e)^2 + (1 | id) + (1 | item)", "binomial", n_agq=0).coef_table()
