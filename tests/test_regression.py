import math

import numpy as np
import pytest

from panelwright.functions.tails import f_upper, t_two_sided
from panelwright.operators import regression as rg


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    n = 120
    a, b, c = rng.normal(50, 4, n), rng.normal(size=n), rng.exponential(size=n)
    y = 3 + 0.5 * a - 2 * b + 0.3 * a * b + rng.normal(size=n)
    g = np.where(np.arange(n) < 70, "big", np.where(np.arange(n) < 114, "mid", "six"))
    rows = [(str(k), *map(float, v)) for k, v in zip(g, np.c_[y, a, b, c, 2 * a - 1])]
    rows[3] = (rows[3][0], None, *rows[3][2:])
    rows[4] = (*rows[4][:4], None, rows[4][5])
    return spark.createDataFrame(rows, "g string, y double, a double, `b.b` double, c double, a2 double"), rows


def reference(x, y):
    x = np.c_[np.ones(len(x)), x]
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    df = len(y) - x.shape[1]
    return beta, np.sqrt(rss / df * np.diag(np.linalg.inv(x.T @ x))), rss, df


def test_fit_matches_lstsq(data):
    df, rows = data
    fit = rg.ols(df, rg.model("y", rg.crossed("a", "b.b"), "c")).orderBy("position").collect()
    assert [r.term for r in fit] == ["(intercept)", "a", "b.b", "c", "a:b.b"]
    full = np.array([r[1:] for r in rows if None not in r])
    y, a, b, c = full[:, :4].T
    beta, error, rss, dof = reference(np.c_[a, b, c, a * b], y)
    assert np.allclose([r.estimate for r in fit], beta) and np.allclose([r.std_error for r in fit], error)
    r2 = 1 - rss / ((y - y.mean()) ** 2).sum()
    top = fit[0]
    assert top.n == 118 and top.dropped == 2 and top.df == dof and top.rank == 4
    assert math.isclose(top.r2, r2) and math.isclose(top.adj_r2, 1 - (1 - r2) * 117 / dof)
    assert math.isclose(top.f, r2 / 4 / ((1 - r2) / dof)) and math.isclose(top.sigma, math.sqrt(rss / dof))


def test_groups_with_too_few_rows_and_collinear_terms(data):
    df, rows = data
    spec = rg.model("y", "a", "a2", "b.b", "c", ("a", "c"), ("a", "b.b"), ("b.b", "c"))
    fit = {(r.g, r.term): r for r in rg.ols(df, spec, by=["g"]).collect()}
    assert len(fit) == 3 * 8
    assert all(fit[g, "a2"].estimate is None for g in ("big", "mid", "six"))
    six = [r for (g, _), r in fit.items() if g == "six"]
    assert six[0].n == 6 and six[0].df == 0 and six[0].rank == 5
    assert sum(r.estimate is not None for r in six) == 6 and all(r.std_error is None and r.p is None for r in six)
    full = np.array([r[1:] for r in rows if None not in r and r[0] == "mid"])
    y, a, b, c = full[:, :4].T
    beta, error, *_ = reference(np.c_[a, b, c, a * c, a * b, b * c], y)
    terms = ["(intercept)", "a", "b.b", "c", "a:c", "a:b.b", "b.b:c"]
    assert np.allclose([fit["mid", t].estimate for t in terms], beta, rtol=1e-6)


def test_residuals(data):
    df, rows = data
    spec = rg.model("y", "a", "b.b")
    fit = rg.ols(df, spec, by=["g"])
    q = {r.g: r for r in rg.residual_quantiles(df, spec, fit, by=["g"]).collect()}
    full = np.array([r[1:] for r in rows if r[1] is not None and r[0] == "big"])
    y, a, b = full[:, :3].astype(float).T
    beta, *_ = reference(np.c_[a, b], y)
    left = y - np.c_[np.ones(len(y)), a, b] @ beta
    assert np.allclose([q["big"][n] for n in ("min", "q1", "median", "q3", "max")], np.quantile(left, [0, 0.25, 0.5, 0.75, 1]))
    assert rg.residual_quantiles(df, spec, rg.ols(df, spec)).count() == 1


def test_interaction_without_its_main_effect():
    spec = rg.model("y", rg.crossed("gdp", "doctors"), "density", "beds", rg.interaction("nurses", "beds"))
    assert spec.names == ["gdp", "doctors", "density", "beds", "gdp:doctors", "nurses:beds"]


def test_empty_group_and_catalogue(spark, data):
    df, _ = data
    none = rg.ols(df.filter("y > 1e9"), rg.model("y", "a")).collect()
    assert all(r.estimate is None and r.n == 0 for r in none)
    both = rg.ols_catalogue({"one": (df, rg.model("y", "a")), "two": (df.filter("g = 'mid'"), rg.model("y", "c"))})
    assert {(r.model, r.term) for r in both.collect()} == {("one", "(intercept)"), ("one", "a"), ("two", "(intercept)"), ("two", "c")}


def test_tails():
    # By integrating the densities.
    def t_density(x, v):
        return math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)

    for v, t in [(1, 0.5), (5, 2.1), (40, 3.0), (300, 1.96)]:
        x = np.linspace(0, t, 20001)
        inside = np.trapezoid([t_density(u, v) for u in x], x)
        assert math.isclose(t_two_sided(t, v), 1 - 2 * inside, abs_tol=1e-8)
        assert math.isclose(f_upper(t * t, 1, v), t_two_sided(t, v), rel_tol=1e-10)
    assert math.isclose(f_upper(3.0, 2, 10), (1 + 2 * 3.0 / 10) ** -5, rel_tol=1e-12)


def test_tails_of_large_degrees_of_freedom():
    from panelwright.functions import tails

    assert math.isclose(tails.t_two_sided(2.0, 1e12), math.erfc(2 / math.sqrt(2)), rel_tol=1e-9)
    for t in (0.1, 1.0, 2.0, 5.0, 8.0):
        exact = tails.beta_regularised(tails.LARGE / 2, 0.5, tails.LARGE / (tails.LARGE + t * t))
        assert math.isclose(tails.t_two_sided(t, tails.LARGE * 1.0001), exact, rel_tol=1e-3)
        assert math.isclose(tails._t_expanded(t, tails.LARGE), exact, rel_tol=1e-9)
        assert math.isclose(tails.f_upper(t * t, 1, 1e9), tails.t_two_sided(t, 1e9), rel_tol=1e-7)
    for f in (0.5, 1.0, 3.0):
        exact = tails.beta_regularised(5e5, 1.5, 1e6 / (1e6 + 3 * f))
        assert math.isclose(tails.f_upper(f, 3, 1e6 + 1), exact, rel_tol=1e-4)
    with pytest.raises(ArithmeticError):
        tails.beta_fraction(1e10, 1e10, 0.5)


def test_more_rows_than_32_bits_count(spark, monkeypatch):
    n = 3_000_000_000
    gram = spark.createDataFrame([("", n, 0, [0.5, 2.0], [0.25, 0.5, 1.25])], "__model string, __n long, __dropped long, __means array<double>, __cross array<double>")
    monkeypatch.setattr(rg, "_gram", lambda *a: gram)
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    rows = rg.ols(df, rg.model("y", "x")).collect()
    assert {r.df for r in rows} == {n - 2} and {r.n for r in rows} == {n}
    assert math.isclose(rows[1].estimate, 2.0) and rows[1].p == 0.0
