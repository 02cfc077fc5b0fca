import duckdb
import numpy as np
import pytest

from mixloom import catalog
from mixloom.functions import covstruct, family, quadrature, special
from mixloom.operators import glmm, inference, influence, lmlist, lmm, nlmm, optimize, plotdata, pls
from mixloom.plans import control, formula

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events", "documents", "labels")


def rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(float(f"{v:.6g}") if isinstance(v, float) else v for v in r.values()) for r in table.select(names).to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, DATA).toArrow()) == rows(con.sql(catalog.ORACLES[name]).to_arrow_table())


#: Closed form for groups of 40 rows each; the caps in it cut nothing from such a table.
_BAL = """with q as (select l_extendedprice / 10000.0::double + 2 * sin(l_suppkey) as y, l_suppkey as g, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as r from lineitem),
f as (select * from q where r <= 40), l as (select g, avg(y) as m, sum((y - (select avg(y) from f z where z.g = f.g)) * 0) as z from f group by g),
b as (select count(*) as ng, avg(m) as mu, var_samp(m) * 40 as msb from l), e as (select sum((f.y - l.m) * (f.y - l.m)) / (count(*) - (select ng from b)) as msw from f join l on f.g = l.g)
select round(mu, 5) as intercept, round(sqrt(msw), 5) as sigma, round(sqrt(greatest(msb - msw, 0) / 40 / msw), 5) as theta from b, e"""


def lineitem_of(spark, path, sizes):
    """A lineitem table with so many rows of each supplier, in folder path."""
    r = np.random.default_rng(8)
    supp = np.repeat(np.arange(1, len(sizes) + 1), sizes)
    rows = [(k, 1, int(g), float(r.integers(1, 51)), float(np.round(20000 + 9000 * r.standard_normal(), 2))) for k, g in enumerate(supp)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    _, _, g, x, price = (np.array(c) for c in zip(*rows, strict=True))
    return g, x, price / 10000 + 2 * np.sin(g)


def dense_reml(g, x, y):
    """Fixed effects, sigma and theta by dense matrices and ever finer grids."""
    z = (g[:, None] == np.unique(g)).astype(float)
    n, p = x.shape

    def at(theta):
        v = np.eye(n) + theta**2 * z @ z.T
        w = np.linalg.solve(v, x)
        b = np.linalg.solve(x.T @ w, w.T @ y)
        r2 = (y - x @ b) @ np.linalg.solve(v, y - x @ b)
        return np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ w)[1] + (n - p) * np.log(r2), b, np.sqrt(r2 / (n - p))

    lo, hi = 0.0, 10.0
    for _ in range(9):
        grid = np.linspace(lo, hi, 21)
        k = int(np.argmin([at(t)[0] for t in grid]))
        lo, hi = grid[max(0, k - 1)], grid[min(20, k + 1)]
    theta = (lo + hi) / 2
    return *at(theta)[1:], theta


def test_whole_table_fits_by_brute_force(spark, tmp_path):
    g, x, y = lineitem_of(spark, tmp_path, [12, 95, 41, 70, 3, 60])
    b, sigma, theta = dense_reml(g, np.ones((len(y), 1)), y)
    got = catalog.QUERIES["lmm_reml_intercept"](spark, str(tmp_path)).first()
    assert np.allclose(tuple(got), (b[0], sigma, theta), rtol=1e-3, atol=1e-4)
    b, sigma, theta = dense_reml(g, np.stack([np.ones(len(y)), x], axis=1), y)
    fit = catalog.QUERIES["lmm_reml_fit"](spark, str(tmp_path)).collect()
    fixed = {r.term: r.value for r in fit if r.part == "fixed"}
    assert np.allclose((fixed["(Intercept)"], fixed["l_quantity"]), b, rtol=1e-3, atol=1e-4)
    sd = {r.grp: r.value for r in fit if r.part not in ("fixed", "mode")}
    assert np.allclose((sd["l_suppkey"], sd["Residual"]), (sigma * theta, sigma), rtol=1e-3, atol=1e-4)


def test_balanced_fit_equals_closed_form(spark, tmp_path):
    lineitem_of(spark, tmp_path, [40] * 8)
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert rows(catalog.QUERIES["lmm_reml_intercept"](spark, str(tmp_path)).toArrow()) == rows(con.sql(_BAL).to_arrow_table())


def test_formula_bars_and_expansion():
    f = formula.parse("y ~ x*f - x:f + offset(o) + (1 + x || a/b) + cs(0 + x | g, hom=TRUE)")
    assert f.terms == (("x",), ("f",)) and f.offset == "o" and f.intercept
    assert [(b.effects, b.groups, b.structure) for b in f.bars] == [(((),), ("a",), "us"), ((("x",),), ("a",), "us"), (((),), ("a", "b"), "us"), ((("x",),), ("a", "b"), "us"), ((("x",),), ("g",), "cs")]
    assert f.bars[-1].hom is True
    assert formula.nobars("y ~ x + (1 | g)") == "y ~ x"
    assert formula.findbars("y ~ x + (x | g)") == ["(1 + x | g)"]
    assert formula.all_vars("y ~ x + (z | g:h)") == ["y", "x", "z", "g", "h"]
    assert formula.parse("cbind(a, b) ~ 1 + (1 | g)").response == ("a", "b")
    with pytest.raises(formula.FormulaError):
        formula.parse("y ~ x + (")


@pytest.mark.parametrize("kind", ["us", "diag", "cs", "ar1"])
def test_structures(kind):
    s = covstruct.make(kind, 3)
    par = s.start() * 0.7 + (0.1 if kind != "us" else 0)
    t = s.factor(par)
    assert np.allclose(t, np.tril(t)) and len(par) == s.n_par
    assert not s.singular(par) and s.singular(np.zeros(s.n_par))
    if kind == "cs":
        v = covstruct.cov2sdcor(t @ t.T)
        assert np.allclose(v[0, 1], v[1, 2])


def test_vector_conversions_round_trip():
    v = np.array([3.0, 4.0, 5.0, 4.0, 5.0, 3.0])
    assert np.allclose(covstruct.vv_to_cv(covstruct.cv_to_vv(v, [3]), [3]), v)
    assert np.allclose(covstruct.sv_to_cv(covstruct.cv_to_sv(v, [3], 2.0), [3], 2.0), v)


def test_special_functions():
    assert abs(special.norm_ppf(0.975) - 1.959963984540054) < 1e-12
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(special.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-9


def test_optimizers():
    o = optimize.nelder_mead(lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2, np.zeros(2), np.array([-5.0, -1.0]), np.array([5.0, 5.0]))
    assert np.allclose(o.par, [1, -1], atol=1e-5)
    assert abs(optimize.golden(lambda x: (x - 0.3) ** 2, 0, 1).par[0] - 0.3) < 1e-6


def frame(spark, seed=3):
    r = np.random.default_rng(seed)
    g, h, x = r.integers(0, 12, 300), r.integers(0, 5, 300), r.normal(size=300)
    y = 1 + 0.5 * x + r.normal(size=12)[g] + 0.4 * r.normal(size=12)[g] * x + r.normal(size=5)[h] + r.normal(size=300)
    n = r.poisson(np.exp(0.3 + 0.2 * np.round(x) + 0.5 * r.normal(size=12)[g]))
    return spark.createDataFrame([(int(a), int(b), float(c), float(d), int(e), float(np.round(c))) for a, b, c, d, e in zip(g, h, x, y, n, strict=True)], "g int, h int, x double, y double, n int, k double"), g, h, x, y


@pytest.mark.parametrize("reml", [True, False])
def test_deviance_equals_dense_likelihood(spark, reml):
    df, g, h, x, y = frame(spark)
    m = lmm.fit_lmm(df, "y ~ x + (x | g) + (1 | h)", reml=reml)
    xx = np.column_stack([np.ones(300), x])
    v = np.eye(300)
    for t, par in zip(m.spec.terms, pls.split(m.spec, m.theta), strict=True):
        lv = g if t.group == "g" else h
        z = xx[:, : len(t.names)]
        f = t.structure.factor(par)
        v += (z @ f @ f.T @ z.T) * (lv[:, None] == lv[None, :])
    vi = np.linalg.inv(v)
    a = xx.T @ vi @ xx
    b = np.linalg.solve(a, xx.T @ vi @ y)
    r2, df_ = (y - xx @ b) @ vi @ (y - xx @ b), 300 - (2 if reml else 0)
    want = np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0) + df_ * (1 + np.log(2 * np.pi * r2 / df_))
    assert abs(m.deviance() - want) < 1e-7 * abs(want) and np.allclose(m.solution.beta, b)


def test_fit_outputs_are_consistent(spark):
    df, *_ = frame(spark)
    m = lmm.fit_lmm(df, "y ~ x + (1 | g)")
    fit = {(r.g, r.x): r.fitted for r in m.fitted().collect()}
    assert all(abs(fit[r.g, r.x] - r.pred) < 1e-9 for r in m.predict(df).collect())
    assert abs(sum(r.hat for r in m.hat().collect())) < 14
    with pytest.raises(ValueError):
        m.predict(df.limit(1).selectExpr("99 as g", "x", "y"))
    assert m.refit_ml().deviance(False) <= m.deviance(False) + 1e-6
    prof = {r.term: r for r in m.confint(method="profile").collect()}
    wald = {r.term: r for r in m.confint().collect()}
    assert abs(prof["x"].lower - wald["x"].lower) < 0.05
    assert m.simulate(2, seed=5).count() == 600
    full = m.influence().where("deleted = '3' and param in ('(Intercept)', 'x')").collect()
    again = lmm.fit_lmm(df.where("g <> 3"), "y ~ x + (1 | g)")
    assert all(abs(r.value - again.fixef()[r.param]) < 1e-4 for r in full)


def test_terms_and_optimizers(spark):
    df, *_ = frame(spark)
    m = lmm.fit_lmm(df.withColumn("f", df.h.cast("string")), "y ~ x + f + (x | g)")
    got = m.anova_terms().collect()
    assert [(r.term, r.npar) for r in got] == [("x", 1), ("f", 4)]
    ns = {r.term: r.sum_sq for r in got}
    c, a = m.solution.a @ m.solution.beta, m.solution.a  # what the first terms explain alone
    explained = [float(c[:k] @ np.linalg.solve(a[:k, :k], c[:k])) for k in (1, 2, 6)]
    assert np.allclose([ns["x"], ns["f"]], np.diff(explained))
    assert all(abs(r.deviance - m.deviance()) < 1e-3 for r in lmm.all_fit(m).collect())
    assert abs(sum(r.share for r in m.re_pca().collect()) - 1) < 1e-12


def test_checks(spark):
    df, *_ = frame(spark)
    with pytest.raises(ValueError, match="2 or more"):
        lmm.fit_lmm(df.withColumn("one", df.g * 0), "y ~ x + (1 | one)")
    with pytest.raises(ValueError, match="0 "):
        lmm.fit_lmm(df.where("g > 99"), "y ~ x + (1 | g)")


def test_poisson_laplace_and_quadrature(spark):
    df, *_ = frame(spark)
    m = glmm.fit_glmm(df, "n ~ k + (1 | g)", "poisson")
    q = glmm.fit_glmm(df, "n ~ k + (1 | g)", "poisson", n_agq=15)
    assert abs(m.deviance - q.deviance) < 0.5
    c, f = m.cells, m.family
    grid = np.linspace(-8, 8, 4001)
    total = 0.0
    for lv in range(len(c.levels[0])):  # brute-force integral over each level's effect
        at = c.at[:, 0] == lv
        eta = (c.o + c.x @ q.beta)[at][:, None] + q.theta[0] * grid[None, :]
        ll = -0.5 * f.minus2loglik(c.y[at][:, None] + 0 * eta, np.exp(eta), c.w[at][:, None], c.times[at][:, None]).sum(axis=0) - grid**2 / 2
        total += -2 * np.log(np.exp(ll - ll.max()).sum() * (grid[1] - grid[0]) / np.sqrt(2 * np.pi)) - 2 * ll.max()
    assert abs(total - q.deviance) < 1e-4 * abs(total)


# -- formulas, checks and designs --------------------------------------------------------------------
def test_arithmetic_in_formulas(spark):
    t = spark.createDataFrame([(2.0, 3.0)], "x double, z double")
    for text, want in (("x^2", 4.0), ("-x^2", -4.0), ("2^x^z", 256.0), ("(x + z)^2 / 5", 5.0), ("x * z^-1", 2 / 3), ("sqrt(x^2)", 2.0)):
        assert abs(t.selectExpr(formula.arithmetic(text)).first()[0] - want) < 1e-12
    assert formula.parse("y ~ I(x^2) + pow(x, 3) + (1 | g)").terms == (("power(x, 2)",), ("pow(x, 3)",))


def test_formula_surgery():
    assert formula.update("y ~ x * f + (x | g) + (1 | h)", ". ~ . - x:f - (1 | h) + z") == "y ~ x + f + z + (1 + x | g)"
    assert formula.update("y ~ x + (1 | g)", "log(y) ~ .").startswith("log(y) ~ x")
    assert formula.re_only("y ~ x + (1 | g)", True) == "y ~ (1 | g)" and formula.no_lhs("y ~ x") == "~x" and formula.with_rhs("y ~ x", "z") == "y ~ z"
    assert formula.expand_double_bars("y ~ (x || g)") == "y ~ (1 | g) + (0 + x | g)" and "diag(x | g)" in formula.expand_double_bars("y ~ (x || g)", "diag")
    assert formula.split_formula("~a / b(c / d)") == ["~a", "~b(c / d)"] and formula.as_one("y ~ x", "z") == "~y + x + z"
    assert formula.groups_formula("y ~ x | g") == "~g" and formula.covariate_formula("y ~ x | g") == "~x" and formula.response_formula("y ~ x") == "~y"
    assert formula.replace_variable("log(x) + x2 + x", "x", "z") == "log(z) + x2 + z" and formula.occurs("y ~ log(x)", "log") and not formula.occurs("y ~ x2", "x")
    with pytest.raises(formula.FormulaError):
        formula.parse_nonlinear("y ~ a * x ~ (1 | g)", ["a"])


def test_controls_and_arguments(spark):
    df, *_ = frame(spark)
    with pytest.raises(ValueError):
        control.lmm_control(rank_x="loud")
    c = control.lmm_control(rank_x="stop", optimizer="simplex", gradient_tol=0.1)
    assert c.checks.rank_x == "stop" and c.convergence.gradient_tol == 0.1
    with pytest.raises(ValueError, match="rank deficient"):
        lmm.fit_lmm(df.withColumn("x2", df.x * 2), "y ~ x + x2 + (1 | g)", control=c)
    with pytest.raises(TypeError, match="unknown"):
        lmm.fit_lmm(df, "y ~ x + (1 | g)", colour=1)
    with pytest.raises(TypeError, match="family"):
        lmm.fit_lmm(df, "y ~ x + (1 | g)", family="poisson")
    with pytest.raises(ValueError, match="no response"):
        lmm.fit_lmm(df, "~ x + (1 | g)")
    with pytest.raises(ValueError, match="one number"):
        lmm.fit_lmm(df.selectExpr("array(y, y) as y", "x", "g"), "y ~ x + (1 | g)")
    with pytest.raises(ValueError, match="negative"):
        lmm.fit_lmm(df.withColumn("w", df.x * 0 - 1), "y ~ x + (1 | g)", weights="w")
    with pytest.warns(control.ModelWarning, match="scales"):
        lmm.fit_lmm(df.withColumn("big", df.x * 1e5), "y ~ big + k + (1 | g)")


def test_user_optimizer(spark):
    df, *_ = frame(spark)
    calls = []

    def own(f, start, low, up, **options):
        calls.append(options)
        o = optimize.nelder_mead(f, start, low, up)
        return o.par, o.value

    a = lmm.fit_lmm(df, "y ~ x + (x | g)", control=control.lmm_control(optimizer=own, options={"level": 3}))
    b = lmm.fit_lmm(df, "y ~ x + (x | g)")
    assert calls[0] == {"level": 3} and abs(a.deviance() - b.deviance()) < 1e-5


@pytest.mark.parametrize("name", sorted(optimize.OPTIMIZERS))
def test_every_optimizer(name):
    inf = np.full(2, np.inf)
    curved = optimize.optimize(lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-1.0, 1.0]), -inf, inf, name)
    assert np.allclose(curved.par, 1, atol=1e-3)
    bounded = optimize.optimize(lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2 + x[0] * x[1], np.zeros(2), np.array([-5.0, -1.0]), np.array([5.0, 5.0]), name)
    assert np.allclose(bounded.par, [1.5, -1], atol=1e-4) and abs(bounded.value + 0.25) < 1e-6


def test_derivatives_and_hessian_checks():
    f = lambda x: float(x[0] ** 2 + 3 * x[0] * x[1] + np.exp(x[1]))
    for at, low in (([0.5, 0.2], None), ([0.0, 0.2], np.zeros(2))):
        g, h = optimize.derivatives(f, np.array(at), low=low)
        assert np.allclose(g, [2 * at[0] + 3 * at[1], 3 * at[0] + np.exp(at[1])], atol=1e-5) and np.allclose(h, [[2, 3], [3, np.exp(at[1])]], atol=1e-2)
    assert [c for c, _ in optimize.check_hessian(np.diag([1.0, -1.0]))] == [-5] and [c for c, _ in optimize.check_hessian(np.diag([1.0, 1e-9]))] == [-4]
    assert {c for c, _ in optimize.check_hessian(np.diag([1e7, 1.0]))} == {2, 3} and [c for c, _ in optimize.check_hessian(np.full((2, 2), np.nan))] == [-6]


@pytest.mark.parametrize("kind", ["us", "diag", "cs", "ar1"])
@pytest.mark.parametrize("hom", [None, True, False])
@pytest.mark.parametrize("nc", [1, 2, 4])
def test_structure_coordinates(kind, hom, nc):
    s, effects = covstruct.make(kind, nc, hom), tuple("abcd")
    p = s.simulate(np.random.default_rng(nc))
    f = s.factor(p)
    v = f @ f.T
    assert np.allclose(s.checked(p), p) and np.allclose(s.factor_of(s.theta(p)), f) and len(s.theta_names("g", effects)) == s.n_theta()
    assert len(s.par_names("g", effects[:nc])) == s.n_par == len(s.profile_names(effects[:nc], "g"))
    for back in (s.factor(s.par_of(s.theta(p))), s.factor(s.par_of_cov(v)), s.factor(s.par_of_profile(s.profile_par(p, 2.0), 2.0)), s.factor(s.par_of_sdcor(*s.sdcor(p, 1.5), 1.5))):
        assert np.allclose(back @ back.T, v, atol=1e-7)
    if kind in ("us", "diag"):
        back = s.factor(s.par_of_profile(s.profile_par(p, 2.0, "varcov"), 2.0, "varcov"))
        assert np.allclose(back @ back.T, v)
    else:
        with pytest.raises(ValueError):
            s.profile_par(p, 2.0, "varcov")
    with pytest.raises(ValueError):
        s.checked(np.append(p, 1.0))


def test_quadrature():
    for n in (1, 5, 40, 100):
        g = quadrature.gauss_hermite(n)
        assert abs(g[:, 1].sum() - 1) < 1e-12 and (n < 2 or abs((g[:, 0] ** 2 * g[:, 1]).sum() - 1) < 1e-9)
    s = quadrature.sparse_grid(3, 3)
    assert abs((s[:, 0] * s[:, 1] ** 2 * s[:, 2] ** 2).sum() - 1) < 1e-10 and abs((s[:, 0] * s[:, 3] ** 4).sum() - 3) < 1e-9
    with pytest.raises(ValueError):
        quadrature.gauss_hermite(101)


@pytest.mark.parametrize("kind", ["treatment", "sum", "helmert", "poly"])
def test_contrasts_fit_the_same_means(spark, kind):
    df, *_ = frame(spark)
    df = df.withColumn("f", df.h.cast("string"))
    a = lmm.fit_lmm(df, "y ~ f + (1 | g)", reml=False)
    b = lmm.fit_lmm(df, "y ~ f + (1 | g)", reml=False, contrasts={"f": kind})
    assert abs(a.deviance() - b.deviance()) < 1e-6 and len(b.spec.x_names) == 5
    new = df.where("f in ('3', '4')").limit(5)
    assert np.allclose([r.pred for r in a.predict(new).collect()], [r.pred for r in b.predict(new).collect()])


# -- predictions, draws and refits ---------------------------------------------------------------------
def test_predict_keeps_levels_and_nulls(spark):
    df, *_ = frame(spark)
    df = df.withColumn("f", df.h.cast("string"))
    m = lmm.fit_lmm(df, "y ~ x * f + (x | g)")
    fit = {(r.g, r.x): r.fitted for r in m.fitted().collect()}
    some = df.where("f in ('2', '4') and g > 3").collect()
    got = m.predict(df.where("f in ('2', '4') and g > 3")).collect()
    assert len(got) == len(some) and all(abs(fit[r.g, r.x] - r.pred) < 1e-9 for r in got)
    with pytest.raises(ValueError, match="unknown levels in f: 9"):
        m.predict(df.limit(2).selectExpr("g", "x", "'9' as f", "1 as pred"))
    odd = spark.createDataFrame([(1, 0.5, "1"), (None, 0.5, "1"), (1, None, "1"), (1, 0.5, None), (99, 0.5, "1")], "g int, x double, f string")
    p = [r.pred for r in m.predict(odd, allow_new=True).collect()]
    assert sum(v is None for v in p) == 3 and len(p) == 5
    assert m.new_levels(odd).collect()[0].level == "99"


def test_standard_errors_of_predictions_by_dense_algebra(spark):
    df, g, h, x, y = frame(spark)
    for text in ("y ~ x + (x | g)", "y ~ x + (x | g) + (1 | h)"):
        m = lmm.fit_lmm(df, text)
        xx = np.column_stack([np.ones(300), x])
        parts = [(g, xx, m.spec.terms[[t.group for t in m.spec.terms].index("g")].structure.factor(pls.split(m.spec, m.theta)[[t.group for t in m.spec.terms].index("g")]))]
        if "h" in text:
            i = [t.group for t in m.spec.terms].index("h")
            parts.append((h, xx[:, :1], m.spec.terms[i].structure.factor(pls.split(m.spec, m.theta)[i])))
        z = np.column_stack([(lv == k)[:, None] * zz for lv, zz, _ in parts for k in range(lv.max() + 1)])
        d = [f @ f.T for lv, _, f in parts for _ in range(lv.max() + 1)]
        q = sum(len(a) for a in d)
        inv, at = np.zeros((q, q)), 0
        for a in d:
            inv[at : at + len(a), at : at + len(a)] = np.linalg.inv(a)
            at += len(a)
        w = np.column_stack([z, xx])
        c = w.T @ w
        c[:q, :q] += inv
        se = m.sigma * np.sqrt(np.einsum("ij,jk,ik->i", w, np.linalg.inv(c), w))
        got = {(r.x, r.y): r.se for r in m.predict(df, se_fit=True).collect()}
        assert np.allclose([got[a, b] for a, b in zip(x, y, strict=True)], se)
        hat = {(r.x, r.y): r.hat for r in m.hat().collect()}
        assert np.allclose([hat[a, b] for a, b in zip(x, y, strict=True)], (se / m.sigma) ** 2)


def test_draws_have_the_model_s_moments(spark):
    t = spark.createDataFrame([(i % 40, 1.0) for i in range(400)], "g int, x double")  # ten equal rows of each group
    y = glmm.simulate_formula(t, "~ x + (x || g)", {"(Intercept)": 1.0, "x": 0.0}, [0.8, 0.6], 0.5, nsim=150, seed=4)
    m = lmm.fit_lmm(y.where("sim_id = 1"), "sim ~ 1 + (1 | g)")
    assert y.select("sim").distinct().count() == 400 * 150
    v = y.groupBy("sim_id", "g").agg({"sim": "avg"}).toPandas()["avg(sim)"]
    assert abs(v.mean() - 1) < 0.06 and abs(v.var() - (0.25 * (0.64 + 0.36) + 0.025)) < 0.03
    s = m.simulate(100, seed=9).groupBy("g").agg({"sim": "var_samp"}).toPandas().iloc[:, 1].mean()
    assert abs(s - m.sigma**2 * (1 + m.theta[0] ** 2)) < 0.15 * s


@pytest.mark.parametrize("name,link,mean,var", [("poisson", "log", 2.0, 2.0), ("Gamma", "log", 2.0, 1.0), ("negative.binomial", "log", 2.0, 4.0), ("inverse.gaussian", "log", 2.0, 2.0), ("binomial", "logit", 0.25, 0.25 * 0.75 / 5), ("gaussian", "identity", 2.0, 0.25)])
def test_samplers(spark, name, link, mean, var):
    t = spark.createDataFrame([(i % 7, 5.0 if name == "binomial" else 1.0) for i in range(2000)], "g int, w double")
    eta = {"log": np.log, "logit": lambda m: np.log(m / (1 - m)), "identity": lambda m: m}[link](mean)
    r = glmm.simulate_formula(t, "~ 1 + (1 | g)", {"(Intercept)": float(eta)}, [0.0], 0.5, name, link, 3, 5, weights="w", nb_theta=2.0).agg({"sim": "avg"}, ).first()
    v = glmm.simulate_formula(t, "~ 1 + (1 | g)", {"(Intercept)": float(eta)}, [0.0], 0.5, name, link, 3, 5, weights="w", nb_theta=2.0).agg({"sim": "var_samp"}).first()
    assert abs(r[0] - mean) < 5 * (var / 6000) ** 0.5 and abs(v[0] / var - 1) < 0.25


def test_refit_update_and_parameters(spark):
    df, *_ = frame(spark)
    m = lmm.fit_lmm(df, "y ~ x + (1 | g)", weights="1 + k * k", offset="0.1 * x")
    a, b = m.refit("2 * y"), lmm.fit_lmm(df.withColumn("y", df.y * 2), "y ~ x + (1 | g)", weights="1 + k * k", offset="0.1 * x")
    assert abs(a.deviance() - b.deviance()) < 1e-6 and np.allclose(a.solution.beta, b.solution.beta, atol=1e-6)
    u = m.update(". ~ . + k")
    assert u.spec.x_names == ["(Intercept)", "x", "k"] and u.call.options["weights"] == "1 + k * k"
    same = m.set_params(m.fixef(), m.theta, m.sigma)
    assert np.allclose(same.solution.b[0], m.solution.b[0]) and abs(same.sigma - m.sigma) < 1e-9
    with pytest.raises(ValueError):
        m.set_params({"x": 1.0})
    other = m.set_params(beta=m.solution.beta + 1.0)
    assert not np.allclose(other.solution.b[0], m.solution.b[0]) and np.allclose(other.vcov(), other.vcov())
    f = lmm.fit_lmm(df, "y ~ x + (1 | g)", devfun_only=True)
    assert abs(f([0.7]) - lmm.fit_lmm(df, "y ~ x + (1 | g)").deviance_function()([0.7])) < 1e-9


def test_drop1_respects_weights_and_scope(spark):
    df, *_ = frame(spark)
    df = df.withColumn("f", df.h.cast("string"))
    m = lmm.fit_lmm(df, "y ~ x * f + k + (1 | g)", weights="1 + k * k")
    got = {r.term: r for r in lmm.drop1(m).collect()}
    assert set(got) == {"<none>", "x:f", "k"}
    small = lmm.fit_lmm(df, "y ~ x * f + (1 | g)", reml=False, weights="1 + k * k")
    assert abs(got["k"].aic - small.aic()) < 1e-5 and abs(got["k"].lrt - (small.deviance() - m.refit_ml().deviance())) < 1e-5
    assert lmm.drop1(m, test=lambda full, less: less.npar, only=["k"]).collect()[1].lrt == m.npar - 1
    with pytest.raises(ValueError):
        lmm.drop1(m, only=["x"])


def test_profile_by_brute_force(spark):
    df, g, h, x, y = frame(spark)
    m = lmm.fit_lmm(df, "y ~ x + (1 | g)", reml=False)
    p = m.profile()
    z = (g[:, None] == np.arange(12)).astype(float)
    xx = np.column_stack([np.ones(300), x])

    def dev(tau, sigma):
        v = sigma**2 * np.eye(300) + tau**2 * z @ z.T
        b = np.linalg.solve(xx.T @ np.linalg.solve(v, xx), xx.T @ np.linalg.solve(v, y))
        r = y - xx @ b
        return np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r) + 300 * np.log(2 * np.pi)

    best = m.deviance()
    for value, zeta in list(zip(*p.curve("sd_(Intercept)|g"), strict=True))[::4]:
        lo, hi = 1.0, 2.5
        opt = optimize.golden(lambda s, v=value: dev(v, s), lo, hi, 1e-7)
        assert abs(np.sign(zeta) * zeta**2 - np.sign(value - p.best["sd_(Intercept)|g"]) * (opt.value - best)) < 1e-3
    ends = {n: (a, b) for n, a, b in p.intervals()}
    wald = {r.term: r for r in m.confint().collect()}
    assert abs(ends["x"][0] - wald["x"].lower) < 0.03 and ends["sigma"][0] < m.sigma < ends["sigma"][1]
    logs = p.transformed("log")
    assert abs(dict((n, a) for n, a, _ in logs.intervals())["log(sigma)"] - np.log(ends["sigma"][0])) < 1e-3
    d = p.density().where("focal = 'x'").toPandas()
    assert 0.9 < np.trapezoid(d.density, d.value) < 1.01 and p.pairs().count() > 0 and p.df().columns == ["focal", "zeta", "value"]


def test_bootstrap(spark):
    df, *_ = frame(spark)
    m = lmm.fit_lmm(df, "y ~ x + (1 | g)")
    reps = lmm.boot(m, 60, seed=3).cache()
    wide = inference.boot_wide(reps).toPandas()
    assert len(wide) == 60 and abs(wide["x"].std() / np.sqrt(m.vcov()[1, 1]) - 1) < 0.35
    for kind in ("perc", "norm", "basic"):
        ends = {n: (a, b) for n, a, b in inference.boot_intervals(reps, 0.9, kind, inference.statistics(m))}
        assert ends["x"][0] < m.fixef()["x"] < ends["x"][1]
    semi = lmm.boot(m, 20, kind="semiparametric", use_u=True)
    assert semi.where("name = 'x'").count() == 20
    failing = lmm.boot(m, 3, fun=lambda fit: 1 / 0).collect()
    assert len(failing) == 3 and all("ZeroDivisionError" in r.message for r in failing)
    with pytest.raises(ValueError):
        lmm.boot(m, 3, kind="semiparametric")


def test_deletions_equal_refits(spark):
    df, *_ = frame(spark)
    for text in ("y ~ x + (1 | g)", "y ~ x + (x | g)"):
        m = lmm.fit_lmm(df, text)
        got = {(r.deleted, r.param): r for r in m.influence().collect()}
        for lv in ("2", "9"):
            a = lmm.fit_lmm(df.where(f"g <> {lv}"), text)
            want = {**a.fixef(), **{f"theta{i}": v for i, v in enumerate(a.theta)}, "sigma": a.sigma}
            assert all(abs(got[lv, n].value - v) < 2e-3 for n, v in want.items())
            assert abs(got[lv, "x"].se - np.sqrt(a.vcov()[1, 1])) < 1e-3
    m = lmm.fit_lmm(df, "y ~ x + (1 | g)")
    rows_ = m.influence("row").where("param = 'x'").toPandas()
    first = df.first()
    again = lmm.fit_lmm(df.where(df.y != first.y), "y ~ x + (1 | g)")
    assert len(rows_) == 300 and np.abs(rows_.value - again.fixef()["x"]).min() < 1e-7
    inf = influence.dfbeta(m).where("deleted = '2' and param = 'x'").first()
    a = lmm.fit_lmm(df.where("g <> 2"), "y ~ x + (1 | g)")
    assert abs(inf.dfbeta - (a.fixef()["x"] - m.fixef()["x"])) < 1e-6 and abs(inf.dfbetas - inf.dfbeta / np.sqrt(a.vcov()[1, 1])) < 1e-5
    d = np.array([a.fixef()[n] - m.fixef()[n] for n in m.spec.x_names])
    assert abs(influence.cooks(m).where("deleted = '2'").first().cooks - d @ np.linalg.solve(m.vcov(), d) / 2) < 1e-5


def test_levels_that_stay_distributed(spark):
    """The same fit, modes and predictions whether level sums come to the driver or not."""
    df, *_ = frame(spark)
    near = lmm.fit_lmm(df, "y ~ x + (x | g)", reml=False)
    spec = lmm.compile_lmm(df, "y ~ x + (x | g)")
    g = lmm.sums_of(spec, most_levels=3)
    assert g.factors[0].table is not None
    par = near.theta
    far = lmm.LMM(spec, g, par, False, pls.solve(spec, g, par), near.optimum)
    assert abs(far.deviance() - near.deviance()) < 1e-8 and np.allclose(far.solution.beta, near.solution.beta)
    a, b = ({(r.term, r.grp): (r.condval, r.condsd) for r in m.ranef().collect()} for m in (near, far))
    assert all(np.allclose(a[k], b[k]) for k in a) and len(a) == len(b) == 24
    assert np.allclose(sorted(r.fitted for r in near.fitted().collect()), sorted(r.fitted for r in far.fitted().collect()))


def test_crossed_factors_by_dense_algebra(spark):
    df, g, h, x, y = frame(spark)
    m = lmm.fit_lmm(df, "y ~ x + (x | g) + (1 | h)", reml=True)
    full = pls.solve(m.spec, m.gram, m.theta)
    c, off = pls.joint(m.spec, m.gram, m.theta)
    for k, f in enumerate(m.gram.factors):
        e = f.zy.shape[1]
        own = np.array([c[off[k] + i * e : off[k] + (i + 1) * e, off[k] + i * e : off[k] + (i + 1) * e] for i in range(len(f.levels))])
        # conditional covariances hold the fixed effects fixed: without their uncertainty
        q, p = off[-1], len(m.solution.beta)
        cx = c[off[k] : off[k] + len(f.levels) * e, q:]
        given = c[off[k] : off[k] + len(f.levels) * e, off[k] : off[k] + len(f.levels) * e] - cx @ np.linalg.solve(c[q:, q:], cx.T)
        assert np.allclose(full.cond[k], [given[i * e : (i + 1) * e, i * e : (i + 1) * e] for i in range(len(f.levels))]) and own.shape == full.cond[k].shape and p == 2
    assert m.get("n_rfacs") == 2 and m.get("Gp") == [0, 24, 29] and abs(m.get("devcomp")["cmp"] - m.deviance()) < 1e-9
    text = str(m.summary())
    assert "REML" in text and "Residual" in text and len(m.get("all")) > 25
    assert abs(sum(r.share for r in m.re_pca().where("grp = 'g'").collect()) - 1) < 1e-12


# -- generalized, nonlinear and grouped fits -----------------------------------------------------------
def test_glmm_of_two_factors_by_quadrature(spark):
    """Laplace over all effects at once equals a dense evaluation."""
    df, g, h, x, y = frame(spark)
    m = glmm.fit_glmm(df, "n ~ k + (1 | g) + (1 | h)", "poisson")
    n = np.array([r.n for r in df.collect()], float)
    k = np.round(x)
    z = np.column_stack([(g[:, None] == np.arange(12)) * m.theta[0], (h[:, None] == np.arange(5)) * m.theta[1]])
    u = np.zeros(17)
    for _ in range(50):
        mu = np.exp(np.column_stack([np.ones(300), k]) @ m.beta + z @ u)
        hess = z.T @ (mu[:, None] * z) + np.eye(17)
        u = u + np.linalg.solve(hess, z.T @ (n - mu) - u)
    from math import lgamma

    want = -2 * sum(n * np.log(mu) - mu - np.array([lgamma(v + 1) for v in n])) + u @ u + np.linalg.slogdet(hess)[1]
    assert abs(m.deviance - want) < 1e-5 * abs(want)
    one = glmm.fit_glmm(df, "n ~ k + (1 | g)", "poisson")
    assert m.deviance <= one.deviance + 1e-6 and m.n_groups == {"g": 12, "h": 5}
    assert abs(m.predict(df, kind="response").agg({"pred": "avg"}).first()[0] - n.mean()) < 0.1
    assert {r.grpvar for r in m.ranef().collect()} == {"g", "h"} and "z value" in str(m)
    assert np.allclose(one.vcov(), one.vcov(use_hessian=False), rtol=0.2)
    assert m.simulate(2, use_u=True).where("sim >= 0 and sim = floor(sim)").count() == 600
    assert abs(one.hat().agg({"hat": "sum"}).first()[0] - 12) < 3 and one.refit("n + 0").deviance - one.deviance < 1e-6


def test_families_with_a_scale(spark):
    r = np.random.default_rng(2)
    g = r.integers(0, 20, 600)
    mu = np.exp(0.4 + 0.5 * r.normal(size=20)[g])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, r.gamma(4, mu / 4), strict=True)], "g int, y double")
    for name in ("Gamma", "inverse.gaussian", "gaussian"):
        m = glmm.fit_glmm(df, "y ~ 1 + (1 | g)", name, "log")
        assert np.isfinite(m.deviance) and abs(m.beta[0] - 0.4) < 0.4 and m.var_corr_df().where("grp = 'Residual'").count() == 1
    assert abs(glmm.fit_glmm(df, "y ~ 1 + (1 | g)", "Gamma", "log").gamma_shape() / 4 - 1) < 0.35
    assert glmm.fit_glmm(df, "y ~ 1 + (1 | g)", "gaussian").is_lmm
    with pytest.raises(ValueError):
        glmm.fit_glmm(df, "y ~ 1 + (1 | g)", "quasipoisson")
    with pytest.raises(ValueError):
        glmm.fit_glmm(df, "y ~ 1 + (1 | g)", "Gamma", n_agq=5)


def test_user_family_equals_built_in(spark):
    df, *_ = frame(spark)
    p = family.Family("poisson", "log")
    own = family.user_family("counts", p.forward, p.inverse, p.slope, p.variance, p.dev_resid, p.aic)
    a, b = glmm.fit_glmm(df, "n ~ k + (1 | g)", own), glmm.fit_glmm(df, "n ~ k + (1 | g)", "poisson")
    assert abs(a.deviance - b.deviance) < 1e-6 and np.allclose(a.beta, b.beta, atol=1e-4)
    assert family.normal_name("Negative Binomial(2)") == "negative.binomial" and family.has_no_scale("poisson") and family.is_negative_binomial("nbinom")


def test_negative_binomial_finds_its_theta(spark):
    r = np.random.default_rng(8)
    g = r.integers(0, 30, 1500)
    mu = np.exp(0.8 + 0.4 * r.normal(size=30)[g])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(g, r.negative_binomial(2, 2 / (2 + mu)), strict=True)], "g int, n int")
    m = glmm.fit_glmm_nb(df, "n ~ 1 + (1 | g)")
    assert abs(m.family.theta / 2 - 1) < 0.3
    near = [glmm.fit_glmm(df, "n ~ 1 + (1 | g)", "negative.binomial", theta_nb=m.family.theta * f).deviance for f in (0.8, 1.25)]
    assert m.deviance < min(near)


def test_nonlinear_fit_by_dense_likelihood(spark):
    r = np.random.default_rng(5)
    g, t = np.repeat(np.arange(10), 15), np.tile(np.linspace(0, 10, 15), 10)
    a = 10 + 1.5 * r.normal(size=10)
    y = a[g] / (1 + np.exp((4 - t) / 1.2)) + 0.3 * r.normal(size=150)
    df = spark.createDataFrame([(int(i), float(b), float(c)) for i, b, c in zip(g, t, y, strict=True)], "g int, x double, y double")
    m = nlmm.fit_nlmm(df, f"y ~ {nlmm.logistic_curve()} ~ (Asym | g)", {"Asym": 9.0, "xmid": 5.0, "scal": 1.0})
    b = m.fixef()
    s = 1 / (1 + np.exp((b["xmid"] - t) / b["scal"]))  # the curve is linear in Asym: the likelihood is normal
    z = (g[:, None] == np.arange(10)) * s[:, None]
    v = np.eye(150) + m.theta[0] ** 2 * z @ z.T
    res = y - b["Asym"] * s
    want = np.linalg.slogdet(v)[1] + 150 * (1 + np.log(2 * np.pi * (res @ np.linalg.solve(v, res)) / 150))
    assert abs(m.deviance - want) < 1e-6 * abs(want) and abs(b["Asym"] - a.mean()) < 0.3 and "Nonlinear" in str(m)
    assert abs(m.fitted().selectExpr("avg(abs(y - fitted))").first()[0] - 0.24) < 0.1
    assert m.predict(spark.createDataFrame([(99, 4.0)], "g int, x double")).first().pred == pytest.approx(b["Asym"] / (1 + np.exp((b["xmid"] - 4) / b["scal"])))
    with pytest.raises(ValueError):
        nlmm.curve_function("__import__('os')", ["x"])
    assert nlmm.stacked(df.limit(2), ["p", "q"]).selectExpr("sum(p)", "sum(q)", "count(*)").first()[:] == (2.0, 2.0, 4)


def test_regressions_by_group(spark):
    df, g, h, x, y = frame(spark)
    fits = lmlist.fit_lm_list(df, "y ~ x + I(x^2) | g", weights="1 + k * k")
    w = 1 + np.round(x) ** 2
    got = {r.grp: r for r in fits.table.collect()}
    rss = 0.0
    for lv in range(12):
        at = g == lv
        xx = np.column_stack([np.ones(at.sum()), x[at], x[at] ** 2])
        b = np.linalg.solve(xx.T @ (w[at][:, None] * xx), xx.T @ (w[at] * y[at]))
        rss += float((w[at] * (y[at] - xx @ b) ** 2).sum())
        assert np.allclose(got[str(lv)].coef, b)
    s, d = fits.pooled()
    assert d == 300 - 36 and abs(s - np.sqrt(rss / d)) < 1e-9
    ends = fits.confint().where("grp = '3' and term = 'x'").first()
    own = got["3"]
    half = special.t_ppf(0.975, d) * s * np.sqrt(own["cov"][4])
    assert abs(ends.upper - own.coef[1] - half) < 1e-8 and abs(ends.lower - own.coef[1] + half) < 1e-8
    assert fits.update(". ~ . - I(x^2)", df).names == ["(Intercept)", "x"] and fits.ranef().count() == 12
    b = lmlist.fit_lm_list(df, "n ~ k | g", "poisson", pool=False)
    assert b.is_glm and not b.has_scale and b.sigma() == 1.0 and b.confint().count() == 24
    flat = lmlist.fit_lm_list(df.withColumn("c", df.x * 0), "y ~ c | g").coef().first()
    assert flat.c is None


def test_plot_tables_and_captured_errors(spark):
    df, g, h, x, y = frame(spark)
    m = lmm.fit_lmm(df, "y ~ x + (1 | g)")
    r = plotdata.residual_scores(m).orderBy("rank").toPandas()
    assert r["rank"].tolist() == list(range(1, 301)) and r.scaled_resid.is_monotonic_increasing
    assert abs(r.score.iloc[0] - special.norm_ppf(0.5 / 300)) < 1e-9 and abs(r.score.sum()) < 1e-6
    s = plotdata.mode_scores(m).toPandas()
    assert sorted(s["rank"]) == list(range(1, 13))
    got = plotdata.attempt(lmm.fit_lmm, df, "y ~ nope + (1 | g)")
    assert got["value"] is None and got["error"] and plotdata.attempt(len, "abc")["value"] == 3
    both = plotdata.combined([df.select("g"), df.select("g", "x")])
    assert both.count() == 600 and both.where("x is null").count() == 300
    assert plotdata.fit_points(lmm.all_fit(m)).count() >= 4
    bad = lmm.all_fit(m, {"broken": lambda f, x, lo, up, **o: 1 / 0}).first()
    assert bad.deviance is None and "ZeroDivisionError" in bad.message


def counts_frame(spark):
    r = np.random.default_rng(5)
    g, k = np.repeat(np.arange(12), 10), np.tile(np.arange(10) / 10, 12)
    n = r.poisson(np.exp(0.4 + 0.5 * k + 0.6 * r.normal(size=12)[g]))
    return g, k, n, spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, k, n, strict=True)], "g int, k double, n int")


def test_standard_errors_of_generalized_predictions_are_those_of_dense_algebra(spark):
    g, k, n, df = counts_frame(spark)
    m = glmm.fit_glmm(df, "n ~ k + (1 | g)", "poisson")
    link, mean = ({(r.g, r.k): r for r in m.predict(df, kind=kind, se_fit=True).collect()} for kind in ("link", "response"))
    x, z = np.column_stack([np.ones(120), k]), np.eye(12)[g]
    w = np.array([mean[int(a), float(b)].pred for a, b in zip(g, k, strict=True)])[:, None]
    both = np.hstack([z, x])
    h = both.T @ (w * both) + np.diag([1 / m.theta[0] ** 2] * 12 + [0, 0])
    want = {(int(a), float(b)): v for a, b, v in zip(g, k, np.sqrt(np.einsum("ij,jk,ik->i", both, np.linalg.inv(h), both)), strict=True)}
    assert len(want) == len(link) == 120
    for at, v in want.items():
        assert abs(link[at].se / v - 1) < 1e-5 and abs(mean[at].se / (v * mean[at].pred) - 1) < 1e-5
    new = spark.createDataFrame([(99, 0.5), (None, 0.5), (3, None)], "g int, k double")
    rows = {(r.g, r.k): r for r in m.predict(new, allow_new=True, se_fit=True).collect()}
    a = np.linalg.inv(h)[12:, 12:]
    v = np.array([1, 0.5])
    assert abs(rows[99, 0.5].se - np.sqrt(v @ a @ v)) < 1e-5 and rows[None, 0.5].se is None and rows[3, None].se is None
    flat = m.predict(new.limit(1), re_form=None, se_fit=True).first()
    assert abs(flat.se - np.sqrt(v @ a @ v)) < 1e-5


def test_profile_limits_of_a_generalized_spread(spark):
    _, _, _, df = counts_frame(spark)
    m = glmm.fit_glmm(df, "n ~ 1 + (1 | g)", "poisson")
    rows = [r for r in m.profile_interval().collect() if r.term not in m.spec.x_names]
    assert len(rows) == 1 and 0 < rows[0].lower < m.theta[0] < rows[0].upper
    for v in (rows[0].lower, rows[0].upper):
        least = min(glmm.laplace(m.cells, m.family, glmm._templates(m.spec, m.cells, np.array([v])), np.array([b]), np.zeros(12), False)[0] for b in np.linspace(m.beta[0] - 1, m.beta[0] + 1, 2001))
        assert abs(np.sqrt(least - m.deviance) - 1.959964) < 2e-3
    even = spark.createDataFrame([(i % 6, 3 + i // 6 % 2) for i in range(24)], "g int, n int")
    low = glmm.fit_glmm(even, "n ~ 1 + (1 | g)", "poisson").profile_interval(which=[rows[0].term]).collect()
    assert len(low) == 1 and low[0].lower == 0 and low[0].upper > 0


def test_quantiles_equal_sorted_ranks(spark):
    r = np.random.default_rng(6)
    v = np.concatenate([r.standard_cauchy(3000), np.full(500, 0.25), np.round(r.normal(size=1000), 1), [1e9]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    for buckets, most in ((65_536, 100_000), (7, 20)):
        assert np.allclose(lmm.quantiles(df, "x", at, buckets, most), np.quantile(v, at), rtol=1e-12)
    assert lmm.quantiles(df.where("x is null"), "x", (0.5,)) == [None]
    assert "percentile" not in lmm.fit_lmm(frame(spark)[0], "y ~ x + (1 | g)").scaled_quantiles()._jdf.queryExecution().toString()


def test_crossed_system_equals_dense(spark, monkeypatch):
    r = np.random.default_rng(3)
    n, big, small = 900, 90, 4
    x, g, h = np.column_stack([np.ones(n), r.normal(size=n)]), r.integers(0, big, n), r.integers(0, small, n)
    w, slope = r.uniform(0.2, 2, n), r.normal(size=n)
    one = np.ones(n)
    for first in (True, False):  # the larger factor before and after the other
        z = np.column_stack([one, slope, one] if first else [one, one, slope])
        at = np.column_stack([2 * g, 2 * g + 1, 2 * big + h] if first else [h, small + 2 * g, small + 2 * g + 1])
        names = lambda k: [str(i) for i in range(k)]
        c = glmm.Cells(one, one, one, one, x, z, at, [names(big), names(small)] if first else [names(small), names(big)], [2, 1] if first else [1, 2], [[0], [1]])
        monkeypatch.setattr(glmm.System, "HELD", 50)
        s = glmm.System(c, w, z)
        dense = np.zeros((n, c.q))
        for k in range(3):
            dense[np.arange(n), at[:, k]] += z[:, k]
        m = dense.T @ (w[:, None] * dense) + np.eye(c.q)
        b = r.normal(size=(c.q, 3))
        assert np.allclose(s.solve(b), np.linalg.solve(m, b)) and np.allclose(s.solve(b[:, 0]), np.linalg.solve(m, b[:, 0]))
        assert np.isclose(s.logdet(), np.linalg.slogdet(m)[1]) and np.allclose(s.gather(w), dense.T @ w)
        zx = dense.T @ (w[:, None] * x)
        assert np.allclose(s.a, x.T @ (w[:, None] * x) - zx.T @ np.linalg.solve(m, zx))
        inv, begin = np.linalg.inv(m), 0
        for got, size in zip(s.blocks([np.eye(k) for k in c.sizes]), c.sizes, strict=True):
            for block in got:
                assert np.allclose(block, inv[begin : begin + size, begin : begin + size])
                begin += size


def test_crossed_factors_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(glmm, "MOST_DENSE", 6)
    df, *_ = frame(spark)
    assert glmm.fit_glmm(df, "n ~ 1 + (1 | g) + (1 | h)", "poisson", n_agq=0).n_groups == {"g": 12, "h": 5}
    monkeypatch.setattr(glmm, "MOST_DENSE", 4)
    with pytest.raises(ValueError):
        glmm.fit_glmm(df, "n ~ 1 + (1 | g) + (1 | h)", "poisson", n_agq=0)


def test_distributed_cells_agree_with_those_on_the_driver(spark, monkeypatch):
    df, *_ = frame(spark)
    fits = []
    for most in (10**6, 20):
        monkeypatch.setattr(glmm, "MOST_CELLS", most)
        monkeypatch.setattr(glmm, "PART", 40)
        fits.append((glmm.fit_glmm(df, "n ~ k + (1 | g)", "poisson"), glmm.fit_glmm(df.withColumn("v", glmm.F.expr("n + 1")), "v ~ 1 + (1 | g)", "Gamma", "log", n_agq=0)))
    for a, b in zip(*fits, strict=True):
        assert isinstance(b.cells, glmm.Shards) and not isinstance(a.cells, glmm.Shards)
        assert b.deviance == pytest.approx(a.deviance, rel=1e-8) and np.allclose(a.beta, b.beta, atol=1e-4) and np.allclose(a.theta, b.theta, atol=1e-4)
        assert (b.n, b.n_groups) == (a.n, a.n_groups) and b.sigma == pytest.approx(a.sigma, rel=1e-4)
        assert np.allclose(a.vcov(use_hessian=False), b.vcov(use_hessian=False), rtol=1e-3)
        one, two = ({r.grp: (r.condval, r.condsd) for r in m.ranef().collect()} for m in (a, b))
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-3) for k in one)
        assert b.fitted().agg({"fitted": "sum"}).first()[0] == pytest.approx(a.fitted().agg({"fitted": "sum"}).first()[0], rel=1e-4)
    assert fits[1][1].gamma_shape() == pytest.approx(fits[0][1].gamma_shape(), rel=1e-5)


def test_distributed_nonlinear_fit(spark, monkeypatch):
    r = np.random.default_rng(5)
    g, t = np.repeat(np.arange(10), 15), np.tile(np.linspace(0, 10, 15), 10)
    y = (10 + 1.5 * r.normal(size=10))[g] / (1 + np.exp((4 - t) / 1.2)) + 0.3 * r.normal(size=150)
    df = spark.createDataFrame([(int(i), float(b), float(c)) for i, b, c in zip(g, t, y, strict=True)], "g int, x double, y double").persist()
    fits = []
    for most in (10**6, 20):
        monkeypatch.setattr(glmm, "MOST_CELLS", most)
        monkeypatch.setattr(glmm, "PART", 50)
        fits.append(nlmm.fit_nlmm(df, f"y ~ {nlmm.logistic_curve()} ~ (Asym | g)", {"Asym": 9.0, "xmid": 5.0, "scal": 1.0}, n_agq=0))
    a, b = fits
    assert isinstance(b.data, glmm.Shards) and b.deviance == pytest.approx(a.deviance, rel=1e-8) and np.allclose(a.beta, b.beta, atol=1e-4)
    assert (b.n, b.n_groups) == (a.n, a.n_groups) and np.allclose(a.theta, b.theta, atol=1e-3) and np.allclose(a.vcov(), b.vcov(), rtol=1e-3)
