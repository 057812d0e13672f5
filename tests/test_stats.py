import math
import random

import numpy as np
import pytest

from panelwright.operators import stats
from panelwright.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.lognormal(size=900)
    y = x * 2 + rng.normal(size=900)
    z = rng.integers(0, 4, size=900).astype(float)  # few values, many copies
    g = rng.choice(["a", "b", None], size=900, p=[0.7, 0.2, 0.1])
    rows = [(None if a is None else str(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x, y, z)]
    rows[5] = (rows[5][0], None, *rows[5][2:])
    return spark.createDataFrame(rows, "g string, x double, y double, z double"), rows


def test_quantiles_match_numpy_per_group(numbers):
    df, rows = numbers
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {(r.g, r.column): r.quantiles for r in exact_quantiles(df, ["g"], ["x", "y", "z"], probabilities).collect()}
    assert len(got) == 9
    for (g, column), q in got.items():
        i = ["g", "x", "y", "z"].index(column)
        values = [r[i] for r in rows if r[0] == g and r[i] is not None]
        assert np.allclose(q, np.quantile(values, probabilities), rtol=1e-12)


def test_quantiles_beyond_the_broadcast_size(numbers, monkeypatch):
    df, rows = numbers
    from panelwright.operators import quantiles

    monkeypatch.setattr(quantiles, "left_join", lambda *a, **k: __import__(
        "panelwright.operators.joins", fromlist=["x"]).left_join(*a, broadcast_rows=0, **k))
    q = exact_quantiles(df, [], ["y"]).first().quantiles
    assert np.allclose(q, np.quantile([r[2] for r in rows], [0.25, 0.5, 0.75]))


def test_summary(numbers):
    df, rows = numbers
    got = {r.column: r for r in stats.table_summary(df).collect()}
    x = [r[1] for r in rows if r[1] is not None]
    assert got["x"].nulls == 1 and got["x"].rows == 900
    assert math.isclose(got["x"].median, np.median(x)) and math.isclose(got["x"].mean, np.mean(x))
    assert got["g"].type == "string" and got["g"].median is None and got["g"].nulls == sum(r[0] is None for r in rows)
    per_group = stats.table_summary(df, by=["g"]).collect()
    assert len(per_group) == 9 and all(r.median is not None for r in per_group)


def test_profile_null_policies(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0), (2, 5.0)], "c int, v double")
    assert {r.c: r.mean_v for r in stats.profile(df, "c", ["v"]).collect()} == {1: None, 2: 4.0}
    assert {r.c: r.mean_v for r in stats.profile(df, "c", ["v"], nulls="skip").collect()} == {1: 2.0, 2: 4.0}
    with pytest.raises(ValueError):
        stats.profile(df, "c", ["v"], nulls="drop")


def test_correlations(numbers, spark):
    df, rows = numbers
    whole = {(r.a, r.b): r.r for r in stats.corr_matrix(df, ["x", "y", "z"]).collect()}
    assert len(whole) == 9 and whole["x", "y"] is None and whole["x", "x"] is None
    skip = {(r.a, r.b): r.r for r in stats.corr_matrix(df, ["x", "y", "z"], nulls="skip").collect()}
    full = np.array([r[1:] for r in rows if r[1] is not None])
    assert math.isclose(skip["x", "y"], np.corrcoef(full.T)[0, 1]) and skip["y", "y"] == 1.0
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "k double, v double")
    assert {(r.a, r.b): r.r for r in stats.corr_matrix(flat, ["k", "v"]).collect()}["k", "v"] is None


def test_prune_drops_the_better_connected_column(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a, c = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((a, a + 0.2 * c + rng.gauss(0, 0.1), c, rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    kept = {r.column: r.keep for r in stats.corr_prune(stats.corr_matrix(df, ["a", "b", "c", "d"]), 0.9).collect()}
    assert kept == {"a": True, "b": False, "c": True, "d": True}


def test_standardize(numbers, spark):
    df, rows = numbers
    z = stats.standardize(df.drop("g"), ["x", "y"]).toPandas()
    assert abs(z.x.mean()) < 1e-12 and math.isclose(z.x.std(), 1.0) and z.x.isna().sum() == 1
    assert list(z.columns) == ["x", "y", "z"]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r.v for r in stats.standardize(flat, ["v"]).collect()] == [None, None]


def test_summary_of_dates(spark):
    rows = [("1970-01-02", "1970-01-01 12:00:00"), ("1970-01-05", "1970-01-02 00:00:00"), (None, None)]
    df = spark.createDataFrame(rows, "d string, t string").selectExpr("cast(d AS date) d", "cast(t AS timestamp) t", "cast(t AS timestamp_ntz) n")
    got = {r["column"]: r for r in stats.table_summary(df).collect()}
    assert (got["d"].min, got["d"].median, got["d"].max, got["d"].nulls) == (1.0, 2.5, 4.0, 1)
    for c in "tn":
        assert (got[c].min, got[c].mean, got[c].max, got[c].nulls) == (0.5, 0.75, 1.0, 1)
