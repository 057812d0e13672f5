"""A country study from CSV files to clusters and regressions, as one use of the operators.

Takes a daily panel of countries with cumulative cases and five country tables, and yields the
tables of the study; every step is lazy but the clusterings, which iterate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.nulls import complete_rows
from panelwright.operators import columns, compare, dbscan, joins, kmeans, regression, stats, ward
from panelwright.operators import thresholds as th
from panelwright.operators.regression import crossed, interaction, model
from panelwright.session import materialise
from panelwright.sources import csv

# Thresholds, dates, bounds, excluded rows and column names of the study.
THRESHOLDS = (100, 1000, 10000, 20000, 100000)
AGGREGATES = ("World",)
OUTLIERS = ("Qatar", "Kuwait", "Singapore", "Bahrain")
SECTIONS = {"day 50": (50, 3000), "day 75": (75, 5000)}
SIGNIFICANT = 20000
UNUSED = (
    "test_units", "tests_units", "continent", "total_tests", "new_tests", "total_tests_per_thousand",
    "new_tests_per_thousand", "new_tests_smoothed", "new_tests_smoothed_per_thousand", "stringency_index",
    "aged_70_older", "extreme_poverty", "handwashing_facilities", "population",
)
RATES = ("total_cases_per_million", "total_deaths_per_million")
SPEEDS = ("days_100_to_1000", "days_1000_to_10000", "days_10000_to_20000")
FEATURE_SETS = {
    "rates": RATES,
    "speeds": SPEEDS,
    "rates and speeds": (*RATES, *SPEEDS),
    "with gdp": (*RATES, *SPEEDS, "gdp_per_capita"),
}
NINE = (
    "population_density", "gdp_per_capita", "life_expectancy", "happiness_score", "nurses_1000_2019",
    "physicians_1000_2019", "diabetes_prevalence", "hospital_beds_per_thousand", "median_age",
)
SEVEN = (
    "population_density", "median_age", "gdp_per_capita", "life_expectancy", "happiness_score",
    "nurses_1000_2019", "physicians_1000_2019",
)
HAPPINESS_PARTS = (
    "hi_dystopia_1_88_residual", "hi_explained_by_freedom_to_make_life_choices", "hi_explained_by_generosity",
    "hi_explained_by_healthy_life_expectancy", "hi_explained_by_perceptions_of_corruption",
    "hi_explained_by_social_support", "hi_explained_by_gdp_per_capita",
)
PROFILE = (
    "total_cases", "total_deaths", *RATES, "median_age", "gdp_per_capita", "hospital_beds_per_thousand",
    "life_expectancy", "physicians_1000_2019", "nurses_1000_2019", "health_expenditure_2018", *SPEEDS,
)
CASES, DEATHS = RATES
GDP_AND_DOCTORS = crossed("gdp_per_capita", "physicians_1000_2019")
WITHOUT_AGE = tuple(c for c in NINE if c != "median_age")
WITHOUT_HAPPINESS = tuple(c for c in NINE if c != "happiness_score")
MODELS = {
    "deaths per million, day 50": ("day 50", model(DEATHS, *NINE)),
    "deaths, day 50": ("day 50", model("total_deaths", *NINE)),
    "deaths per million with interactions, day 50": (
        "day 50",
        model(
            DEATHS, GDP_AND_DOCTORS, "population_density", "hospital_beds_per_thousand",
            interaction("nurses_1000_2019", "hospital_beds_per_thousand"),
        ),
    ),
    "deaths per million, day 75": ("day 75", model(DEATHS, *SEVEN)),
    "deaths per million by happiness, day 50": ("day 50", model(DEATHS, *HAPPINESS_PARTS)),
    "deaths per million, now": ("now", model(DEATHS, *WITHOUT_AGE)),
    "cases per million, day 50": ("day 50", model(CASES, *NINE)),
    "cases, day 50": ("day 50", model("total_cases", *NINE)),
    "cases per million with interactions, day 50": (
        "day 50", model(CASES, GDP_AND_DOCTORS, "population_density", "hospital_beds_per_thousand")
    ),
    "cases per million, day 75": ("day 75", model(CASES, *SEVEN)),
    "cases per million by happiness, day 50": ("day 50", model(CASES, *HAPPINESS_PARTS)),
    "cases per million, now": ("now", model(CASES, *NINE)),
}


@dataclass(frozen=True)
class Sources:
    """Paths of the panel and of the five country tables."""

    panel: str
    health_expenditure: str
    happiness: str
    life_expectancy: str
    nurses: str
    physicians: str


def load(spark: SparkSession, paths: Sources, panel_schema: str | None = None) -> DataFrame:
    """The panel without aggregates and unused columns, with the country tables attached."""
    panel = csv.read_csv(spark, paths.panel, panel_schema)
    if dict(panel.dtypes)["date"] == "string":
        panel = columns.parse_date(panel, "date")
    panel = columns.drop(columns.exclude(panel, "location", AGGREGATES), ["test_units", "continent"])

    def indicator(path: str, year: str, name: str) -> DataFrame:
        table = columns.rename(csv.read_csv(spark, path), {year: name})
        return columns.project(table, ["Country Code", name])

    happiness = csv.read_csv(spark, paths.happiness)
    marked = {c: f"HI-{c}" for c in happiness.columns if c not in ("Country", "Happiness score")}
    happiness = csv.sanitize_names(columns.rename(happiness, marked))
    tables = [
        joins.Dimension(indicator(paths.health_expenditure, "2018", "health_expenditure_2018"), "iso_code", "Country Code"),
        joins.Dimension(happiness, "location", "country"),
        joins.Dimension(indicator(paths.life_expectancy, "2019", "life_expectancy_2019"), "iso_code", "Country Code"),
        joins.Dimension(indicator(paths.nurses, "2019", "nurses_1000_2019"), "iso_code", "Country Code"),
        joins.Dimension(indicator(paths.physicians, "2019", "physicians_1000_2019"), "iso_code", "Country Code"),
    ]
    for d in tables:
        columns.require_unique(d.table, [d.right_key])
    return joins.enrich(panel, tables)


def running(enriched: DataFrame) -> DataFrame:
    return th.threshold_counters(enriched, "location", "date", "total_cases", THRESHOLDS)


def current(run: DataFrame, as_of: th.AsOf = "max", *, lookahead: bool = True) -> DataFrame:
    """The rows of one date past 100 cases, with durations; crossings after the date count if lookahead."""
    date = th.resolve_as_of(run, "date", as_of)
    spans = th.durations(run, "location", THRESHOLDS, time="date", as_of=None if lookahead else date)
    return th.with_durations(th.cross_section(run, "date", date, reached=100), spans, "location")


def significant(now: DataFrame) -> DataFrame:
    kept = th.significant(now, "total_cases", SIGNIFICANT)
    return columns.drop(kept, [*UNUSED, *[th.bucket_name(t) for t in THRESHOLDS]])


def regressions(run: DataFrame, now: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The models on day 50, on day 75 and on the current date, one row per model and term."""
    tables = {"now": now}
    for label, (day, above) in SECTIONS.items():
        tables[label] = th.day_n_section(run, 100, day, "total_cases", above)
    chosen = {n: MODELS[n] for n in names or MODELS}
    return regression.ols_catalogue({n: (tables[section], spec) for n, (section, spec) in chosen.items()})


def feature_table(now: DataFrame, feature_set: str, *, without: Sequence[str] = (), scale: bool = True) -> DataFrame:
    """(location, features), without outliers if named, complete and standardised."""
    names = FEATURE_SETS[feature_set]
    table = columns.exclude(columns.project(now, ["location", *names]), "location", without)
    table = complete_rows(table, names, "skip")
    return materialise(stats.standardize(table, names) if scale else table, "study-features")


def correlations(now: DataFrame, feature_set: str, without: Sequence[str] = ()) -> DataFrame:
    return stats.corr_matrix(feature_table(now, feature_set, without=without), FEATURE_SETS[feature_set])


def kmeans_study(now, feature_set="with gdp", *, without=OUTLIERS, scale=True, k=4, **options) -> tuple[DataFrame, DataFrame]:
    """(elbow table for k = 2..9, labels at k)."""
    names = FEATURE_SETS[feature_set]
    table = feature_table(now, feature_set, without=without, scale=scale)
    fits = kmeans.kmeans_sweep(table, "location", names, **options)
    labels = kmeans.assign(table, names, fits.of(k), "cluster_assignment_kmeans")
    return kmeans.elbow(fits), labels.select("location", "cluster_assignment_kmeans")


def density_study(now, grid: Sequence[tuple[float, int]], feature_set="with gdp", *, without=OUTLIERS) -> DataFrame:
    table = feature_table(now, feature_set, without=without)
    return dbscan.dbscan_sweep(table, "location", FEATURE_SETS[feature_set], grid)


def ward_study(now, feature_set="with gdp", *, without=OUTLIERS, k=4, elbow_scaled=False) -> tuple[DataFrame, DataFrame]:
    """(elbow table for k = 1..10, labels at k); the elbow is taken on unscaled features by default."""
    names = FEATURE_SETS[feature_set]
    table = feature_table(now, feature_set, without=without)
    tree = ward.ward_tree(table, "location", names)
    labels = ward.cut(table, "location", tree, k).withColumnRenamed("cluster", "cluster_assignment_hclust")
    if not elbow_scaled:
        tree = ward.ward_tree(feature_table(now, feature_set, without=without, scale=False), "location", names)
    return ward.elbow(tree), labels


def comparison(now: DataFrame, by_means: DataFrame, by_tree: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Features with both labelings; the tree's labels are renamed by a map, or to their best match."""
    table = columns.exclude(columns.project(now, ["location", *FEATURE_SETS["with gdp"]]), "location", OUTLIERS)
    both = compare.attach_labels(compare.attach_labels(table, by_means, "location"), by_tree, "location")
    if mapping is None:
        both = materialise(both, "comparison")
        mapping = compare.best_match(both, "cluster_assignment_hclust", "cluster_assignment_kmeans")
    return compare.relabel(both, "cluster_assignment_hclust", mapping)


def outliers(now: DataFrame) -> DataFrame:
    return columns.keep(now, "location", OUTLIERS)


def profiles(now: DataFrame, labels: DataFrame, *, nulls: str = "propagate") -> DataFrame:
    label = [c for c in labels.columns if c != "location"][0]
    return stats.profile(compare.attach_labels(now, labels, "location", only_labelled=True), label, PROFILE, nulls=nulls)


def cluster_regressions(now: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases and deaths per million on the nine predictors in every cluster, and without happiness."""
    label = [c for c in labels.columns if c != "location"][0]
    labelled = compare.attach_labels(now, labels, "location", only_labelled=True)
    fits = None
    for response in (CASES, DEATHS):
        for name, predictors in (("nine", NINE), ("without happiness", WITHOUT_HAPPINESS)):
            fit = regression.ols(labelled, model(response, *predictors), by=[label])
            fit = fit.withColumns({"response": F.lit(response), "predictors": F.lit(name)})
            fits = fit if fits is None else fits.unionByName(fit)
    return fits


def export(now: DataFrame, labels: DataFrame, path: str) -> None:
    """One folder of CSV per cluster."""
    label = [c for c in labels.columns if c != "location"][0]
    csv.write_csv(compare.attach_labels(now, labels, "location", only_labelled=True), path, partition_by=[label])
