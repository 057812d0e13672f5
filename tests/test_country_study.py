import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelwright.plans import country_study as cs
from panelwright.session import materialise, scratch_path
from panelwright.sources import csv

COUNTRIES = [f"Land {i:02d}" for i in range(36)] + list(cs.OUTLIERS)
DAYS = 110


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    folder = tmp_path_factory.mktemp("study")
    panel, facts = [], []
    for i, name in enumerate([*COUNTRIES, "World"]):
        rate = rng.uniform(1.08, 1.16)
        cases = np.round(20 * rate ** np.arange(DAYS))
        fixed = rng.uniform(1, 9, size=6)
        for d in range(DAYS):
            panel.append((
                f"C{i:02d}", "Europe", name, (dt.date(2020, 3, 1) + dt.timedelta(days=d)).isoformat(),
                cases[d], np.round(cases[d] * 0.03), cases[d] / (5 + i), cases[d] * 0.03 / (4 + i), "samples", *fixed,
            ))
        facts.append((name, f"C{i:02d}", *rng.uniform(1, 9, size=4)))
    names = [
        "iso_code", "continent", "location", "date", "total_cases", "total_deaths", *cs.RATES, "tests_units",
        "population_density", "gdp_per_capita", "life_expectancy", "median_age", "diabetes_prevalence",
        "hospital_beds_per_thousand",
    ]
    panel = pd.DataFrame(panel, columns=names)
    panel.to_csv(folder / "panel.csv", index=False, na_rep="")
    for n, (file, year) in enumerate([("health", "2018"), ("life", "2019"), ("nurses", "2019"), ("physicians", "2019")]):
        rows = [(f[0], f[1], f[2 + n]) for f in facts]
        pd.DataFrame(rows, columns=["Country Name", "Country Code", year]).to_csv(folder / f"{file}.csv", index=False)
    head = ["Country", "Happiness score", "Whisker-high", "Dystopia (1.88) + residual"] + [
        f"Explained by: {c}" for c in (
            "GDP per capita", "Social support", "Healthy life expectancy", "Freedom to make life choices",
            "Generosity", "Perceptions of corruption")]
    happy = pd.DataFrame([(f[0], *rng.uniform(0, 5, size=9)) for f in facts[:-2]], columns=head)
    happy.to_csv(folder / "happiness.csv", index=False)
    p = {n: str(folder / f"{n}.csv") for n in ("panel", "health", "happiness", "life", "nurses", "physicians")}
    enriched = cs.load(spark, cs.Sources(p["panel"], p["health"], p["happiness"], p["life"], p["nurses"], p["physicians"]))
    run = materialise(cs.running(enriched), "test-run")
    return panel, run, materialise(cs.significant(cs.current(run)), "test-now")


def test_panel_to_features(study):
    panel, run, now = study
    assert run.filter("location = 'World'").count() == 0 and run.count() == len(COUNTRIES) * DAYS
    assert run.filter("happiness_score is null").select("location").distinct().count() == 1
    rows = {r.location: r for r in now.collect()}
    for name in COUNTRIES:
        cases = panel[panel.location == name].total_cases.to_numpy()
        assert (name in rows) == (cases[-1] >= 20000)
        if name in rows:
            for a, b in [(100, 1000), (1000, 10000), (10000, 20000)]:
                assert rows[name][f"days_{a}_to_{b}"] == (cases >= a).argmax() * -1 + (cases >= b).argmax() + 1
    assert not set(cs.UNUSED) & set(now.columns) and "bucket_100" not in now.columns


def test_lookahead(study):
    _, run, _ = study
    early = cs.current(run, "2020-04-10", lookahead=False)
    assert early.filter("days_100_to_20000 is not null").count() == 0
    assert cs.current(run, "2020-04-10").filter("days_100_to_20000 is not null").count() > 0


def test_regressions(study):
    _, run, now = study
    fits = cs.regressions(run, now).select("model", "term", "n", "estimate").collect()
    assert {r.model for r in fits} == set(cs.MODELS)
    terms = [r.term for r in fits if r.model == "deaths per million with interactions, day 50"]
    assert set(terms) == {
        "(intercept)", "gdp_per_capita", "physicians_1000_2019", "population_density", "hospital_beds_per_thousand",
        "gdp_per_capita:physicians_1000_2019", "nurses_1000_2019:hospital_beds_per_thousand"}


def test_clusters_and_their_comparison(study, spark):
    _, _, now = study
    matrix = {(r.a, r.b): r.r for r in cs.correlations(now, "speeds").collect()}
    assert len(matrix) == 9 and matrix["days_100_to_1000", "days_1000_to_10000"] > 0.5
    elbow, by_means = cs.kmeans_study(now, starts=5)
    assert [r.k for r in elbow.orderBy("k").collect()] == list(range(2, 10))
    by_means = materialise(by_means, "test-labels")
    tree_elbow, by_tree = cs.ward_study(now, elbow_scaled=True)
    wss = [r.wss for r in tree_elbow.orderBy("k").collect()]
    assert len(wss) == 10 and wss == sorted(wss, reverse=True)
    both = cs.comparison(now, by_means, by_tree).toPandas()
    assert not set(both.location) & set(cs.OUTLIERS)
    agree = (both.cluster_assignment_kmeans.astype(str) == both.cluster_assignment_hclust).mean()
    assert agree > 0.6
    assert cs.outliers(now).count() <= 4
    profile = cs.profiles(now, by_means).collect()
    assert len(profile) == 4 and all(r.mean_total_cases for r in profile)
    fits = cs.cluster_regressions(now, by_means)
    assert fits.filter("position = 0").count() == 16
    path = scratch_path(spark, "test-export")
    cs.export(now, by_means, path)
    back = csv.read_csv(spark, path)
    assert back.count() == by_means.count() and "cluster_assignment_kmeans" in back.columns


def test_density(study):
    _, _, now = study
    sizes = cs.density_study(now, [(1.0, 2), (1.5, 5)]).collect()
    total = {}
    for r in sizes:
        total[r.eps, r.min_pts] = total.get((r.eps, r.min_pts), 0) + r["size"]
    assert len(set(total.values())) == 1 and len(total) == 2
