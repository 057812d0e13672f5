"""Nearest entities and distances with missing coordinates, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import neighbours


def squares_of(p, q):
    total = 0.0  # not sum(), which compensates rounding
    for a, b in zip(p, q):
        total += (a - b) ** 2
    return total


def plain_nearest(rows, m):
    out = []
    for name, *p in rows:
        gaps = sorted((squares_of(p, q), other) for other, *q in rows if other != name)
        out += [(name, i + 1, other, math.sqrt(d2)) for i, (d2, other) in enumerate(gaps[:m])]
    return sorted(out)


def heavy(n, d, seed):
    """Points with a heavy tail, a crowd of copies and ties on a lattice."""
    rng = random.Random(seed)
    rows = [(i, *[float(rng.choice([1, -1]) * round(rng.paretovariate(0.8), 2)) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, *[1.0] * d) for i in range(n // 3)]
    rows += [(2 * n + i, *[float(i >> j & 1) for j in range(d)]) for i in range(n // 6)]
    return rows


def frame(spark, rows, d):
    return spark.createDataFrame(rows, "name long, " + ", ".join(f"f{i} double" for i in range(d))).repartition(3)


@pytest.mark.parametrize("d, cell, fan", [(1, 8, 3), (2, 16, 4), (6, 16, 4), (6, 256, 16)])
def test_nearest_against_all_pairs(spark, monkeypatch, d, cell, fan):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "FAN", fan)
    rows = heavy(180, d, d)
    got = neighbours.nearest(frame(spark, rows, d), "name", [f"f{i}" for i in range(d)], 5).collect()
    assert sorted(map(tuple, got)) == plain_nearest(rows, 5)


def test_few_entities_and_none(spark):
    names = ["f0", "f1"]
    for rows in ([(1, 0.0, -0.0), (2, 3.0, 4.0)], [(7, 1.0, 1.0)], [(1, 0.0, 0.0), (2, -0.0, 0.0), (3, 0.0, 0.0)], []):
        got = neighbours.nearest(frame(spark, rows, 2), "name", names, 5)
        assert got.columns == ["name", "rank", "neighbour", "distance"]
        assert sorted(map(tuple, got.collect())) == plain_nearest(rows, 5)


def test_text_ids_and_missing_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", 2.5)], "name string, f0 double")
    got = neighbours.nearest(rows, "name", ["f0"], 1, invalid="skip").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "b", 1.0), ("b", 1, "d", 0.5), ("d", 1, "b", 0.5)]
    with pytest.raises(Exception, match="missing value in x0"):
        neighbours.nearest(rows, "name", ["f0"], 1).collect()


def test_candidates_stay_below_the_square(spark, monkeypatch):
    """Heavy tails in six features: two thirds of the pairs of cells and more go before any point is compared."""
    monkeypatch.setattr(neighbours, "CELL", 32)
    monkeypatch.setattr(neighbours, "FAN", 8)
    seen = []
    real = neighbours._cell_pairs
    monkeypatch.setattr(neighbours, "_cell_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    rng, n = random.Random(1), 2400
    rows = [(i, *[rng.paretovariate(1.2) for _ in range(6)]) for i in range(n)]
    got = neighbours.nearest(frame(spark, rows, 6), "name", [f"f{i}" for i in range(6)], 5)
    assert got.count() == 5 * n
    cells = seen[0].select("node").distinct().count()
    assert cells > n / 32 and seen[0].count() < cells * cells / 3


def plain_partners(rows, within):
    out = []
    for name, *p in rows:
        near, comparable = [], 0
        for other, *q in rows:
            both = [(a, b) for a, b in zip(p, q) if a is not None and b is not None]
            if other != name and both:
                comparable += 1
                squares = 0.0
                for a, b in both:
                    squares += (a - b) * (a - b)
                gap = math.sqrt(squares * len(p) / len(both))
                if gap <= within:
                    near.append((gap, other))
        best = min(near, default=(None, None))
        out.append((name, sum(v is not None for v in p), comparable, len(near), best[1], best[0]))
    return sorted(out)


@pytest.mark.parametrize("d", [1, 3, 5])
def test_partners_with_missing_coordinates(spark, d):
    rng = random.Random(d)
    rows = [(i, *[None if rng.random() < 0.3 else round(rng.gauss(0, 2), 1) for _ in range(d)]) for i in range(120)]
    rows += [(500, *[None] * d), (501, *[0.5] * d), (502, *[0.5] * d)]
    got = neighbours.partners_with_missing(frame(spark, rows, d), "name", [f"f{i}" for i in range(d)], 1.0).collect()
    assert sorted(map(tuple, got)) == plain_partners(rows, 1.0)


def test_partners_of_empty_and_all_missing_tables(spark):
    assert neighbours.partners_with_missing(frame(spark, [], 2), "name", ["f0", "f1"], 1.0).count() == 0
    only = frame(spark, [(1, None, None), (2, float("nan"), None)], 2)
    got = neighbours.partners_with_missing(only, "name", ["f0", "f1"], 1.0).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, None, None), (2, 0, 0, 0, None, None)]


def test_partners_among_copies_and_missing_ids(spark):
    """Copies are partners at distance zero, also beside points of other classes; a row without an id is nobody's."""
    rows = [(i, 0.5, 1.0) for i in (7, 3, 9)] + [(1, 0.5, None), (20, None, 1.0), (4, None, 1.0), (5, 0.75, 1.0), (None, 0.5, 1.0), (None, None, None)]
    got = neighbours.partners_with_missing(frame(spark, rows, 2), "name", ["f0", "f1"], 1.0).collect()
    assert sorted(tuple(r) for r in got if r.name is not None) == [
        (*row[:2], row[2] + 1, *row[3:]) for row in plain_partners([r for r in rows if r[0] is not None], 1.0)
    ]
    assert sorted(tuple(r)[1:] for r in got if r.name is None) == [(0, 0, 0, None, None), (2, 7, 0, None, None)]


def test_pairs_of_a_crowd_are_not_sorted(spark, monkeypatch):
    """A thousand copies and a crowd around them: counts and ids come from hash aggregates over distinct points."""
    stored, real = {}, neighbours.materialise
    monkeypatch.setattr(neighbours, "materialise", lambda df, label: stored.setdefault(label, (df, real(df, label)))[1])
    rows = [(i, 1.0, 2.0) for i in range(1000)] + [(1000 + i, 1.0 + i / 1000, None) for i in range(100)]
    got = neighbours.partners_with_missing(frame(spark, rows, 2), "name", ["f0", "f1"], 2.0).collect()
    assert {r.near for r in got} == {1099}
    assert stored["distinct-points"][1].count() == 101
    assert "SortAggregate" not in stored["least-distances"][0]._jdf.queryExecution().executedPlan().toString()


def test_a_crowd_that_looks_into_one_cell_is_divided(spark, monkeypatch):
    """Points that look into a cell meet it in portions, in several tasks, and none is lost."""
    monkeypatch.setattr(neighbours, "PROBES", 64)
    monkeypatch.setattr(neighbours, "PAIRS_PER_TASK", 5000)
    draw = random.Random(3)
    cell = [(i, draw.randrange(40) / 40) for i in range(50)]  # with ties
    looking = [(1000 + i, draw.uniform(-0.2, 1.2)) for i in range(1000)]
    there = spark.createDataFrame([("0", i, x, x) for i, x in cell], "node string, near bigint, dp double, x0 double")
    probe = [("0", i, abs(y), 0.1, y) for i, y in looking]
    probe = spark.createDataFrame(probe, "other string, pid bigint, gap double, within double, y0 double")
    found = neighbours._across_cells(probe, there, ["x0"], 3, "bigint").withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in found}) > 2
    expected = []
    for i, y in looking:
        near = sorted(((x - y) * (x - y), j) for j, x in cell)
        expected += [(i, j, d2) for d2, j in near if d2 <= 0.1 * 0.1 and abs(abs(y) - dict(cell)[j]) <= 0.1][:3]
    assert sorted((r["pid"], r["near"], r["d2"]) for r in found) == sorted(expected)
