"""Multi-start k-means for many k at once.

All starts of all k advance together: one iteration is one pass over the points, in which every
task measures its own rows against all centres and hands on sums per centre. The centres (at
most starts x sum of k rows) are all that reaches the driver, and the number of passes is the
number of iterations, not of fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.nulls import complete_rows
from panelwright.operators.columns import quoted
from panelwright.session import materialise, materialise_counted, spread

CHUNK = 2_000
CANDIDATES = 20_000
# Coordinate differences one task computes per pass.
WORK_PER_TASK = 200_000_000


@dataclass(frozen=True)
class KMeansFits:
    """The best start per k: centres holds (k, cluster, size, withinss, centre)."""

    centres: DataFrame
    features: tuple[str, ...]

    def of(self, k: int) -> list[tuple[int, list[float]]]:
        """The k labelled centres of one fit."""
        rows = self.centres.filter(F.col("k") == k).orderBy("cluster").collect()
        return [(r["cluster"], list(r["centre"])) for r in rows]


def kmeans_sweep(
    df: DataFrame,
    id_column: str,
    features: Sequence[str],
    ks: Sequence[int] = range(2, 10),
    *,
    starts: int = 25,
    max_iter: int = 25,
    seed: int = 123,
    invalid: str = "error",
) -> KMeansFits:
    """Fit every k from `starts` draws of distinct points and keep the lowest total of squares.

    Clusters are numbered 1..k in the order of their centres, so equal fits get equal labels.
    """
    ks, features = sorted(set(ks)), list(features)
    rows = df.select(quoted(id_column).alias("__id"), *[quoted(f).cast("double").alias(f) for f in features])
    points, n = materialise_counted(complete_rows(rows, features, invalid), "points")
    work = float(n) * len(features) * starts * sum(ks)
    divided = spread(points, work, WORK_PER_TASK)
    points = points if divided is points else materialise(divided, "spread-points")
    drawn = _draws(points, n, features, ks[-1], starts, seed)

    names = [f"__x{i}" for i in range(len(features))]
    coordinates = points.select(*[quoted(f).alias(n) for f, n in zip(features, names)])
    models = {(k, s): drawn[s][:k].copy() for k in ks for s in range(1, starts + 1)}
    moving = dict(models)
    for _ in range(max_iter):
        sums = _pass(coordinates, moving)
        still = {}
        for key, centres in moving.items():
            moved = centres.copy()
            for cluster, (n, _, total) in sums.get(key, {}).items():
                moved[cluster] = total / n
            models[key] = moved
            if not np.allclose(moved, centres, rtol=1e-12, atol=1e-12):
                still[key] = moved
        moving = still
        if not moving:
            break

    final = _pass(coordinates, models)
    cost = {key: sum(c for _, c, _ in parts.values()) for key, parts in final.items()}
    best = []
    for k in ks:
        start = min(range(1, starts + 1), key=lambda s: (cost[k, s], s))
        order = sorted(range(k), key=lambda c: tuple(models[k, start][c]))
        for label, c in enumerate(order, 1):
            n, within, _ = final[k, start].get(c, (0, 0.0, None))
            best.append((k, label, int(n), float(within), [float(v) for v in models[k, start][c]]))
    schema = "k int, cluster int, size long, withinss double, centre array<double>"
    return KMeansFits(df.sparkSession.createDataFrame(best, schema), tuple(features))


def _draws(points: DataFrame, n: int, features: list[str], k: int, starts: int, seed: int) -> dict[int, np.ndarray]:
    """Per start k distinct points: those whose rows have the smallest hash of (seed, start, id).

    Rows are hashed and filtered first, and only the few that are left are checked for copies of
    a point, so the table is neither shuffled nor stored for its draws.
    """
    share = min(1.0, CANDIDATES / max(1, n))
    while True:
        tried = points.withColumn("__start", F.explode(F.sequence(F.lit(1), F.lit(starts))))
        tried = tried.withColumn(
            "__draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("__start"), F.col("__id").cast("string")))
        )
        if share < 1.0:
            # A hash under this bound, so that each start ranks about CANDIDATES points only.
            tried = tried.filter(F.col("__draw") < f"{int(share * 16**8):08x}")
        first = F.min(F.struct("__draw", "__id")).alias("__first")
        tried = tried.groupBy("__start", *[quoted(f) for f in features]).agg(first)
        place = F.row_number().over(Window.partitionBy("__start").orderBy("__first"))
        picked = tried.withColumn("__place", place).filter(F.col("__place") <= k).collect()
        draws: dict[int, list] = {s: [] for s in range(1, starts + 1)}
        for r in sorted(picked, key=lambda r: r["__place"]):
            draws[r["__start"]].append([r[f] for f in features])
        if all(len(d) == k for d in draws.values()):
            return {s: np.array(d, dtype=float) for s, d in draws.items()}
        if share >= 1.0:
            raise ValueError(f"{k} clusters asked of {min(map(len, draws.values()))} distinct points")
        share = min(1.0, share * 10)


def _pass(points: DataFrame, models: dict[tuple[int, int], np.ndarray]) -> dict:
    """Per model and centre: number of its points, their squared distances, their coordinate sums."""
    stacks = {}
    for k in sorted({k for k, _ in models}):
        starts = sorted(s for kk, s in models if kk == k)
        stacks[k] = (starts, np.concatenate([models[k, s] for s in starts]))
    names = points.columns

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {k: np.zeros((len(c), 2 + len(names))) for k, (_, c) in stacks.items()}
        for batch in batches:
            whole = batch.to_numpy(dtype=float)
            for lo in range(0, len(whole), CHUNK):
                x = whole[lo : lo + CHUNK]
                for k, (starts, centres) in stacks.items():
                    held[k] += _sums(x, centres, k)
        for k, (starts, centres) in stacks.items():
            table = pd.DataFrame(held[k], columns=["n", "cost", *names])
            table.insert(0, "centre", np.tile(np.arange(k), len(starts)))
            table.insert(0, "start", np.repeat(starts, k))
            table.insert(0, "k", k)
            yield table[table["n"] > 0]

    schema = "k int, start int, centre int, n double, cost double, " + ", ".join(f"{n} double" for n in names)
    totals = points.mapInPandas(partial, schema).groupBy("k", "start", "centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(n).alias(n) for n in names]
    )
    out: dict = {}
    for r in totals.collect():
        total = np.array([r[n] for n in names])
        out.setdefault((r["k"], r["start"]), {})[r["centre"]] = (r["n"], r["cost"], total)
    return out


def _sums(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    distance = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        distance += (x[:, j, None] - centres[None, :, j]) ** 2
    nearest = distance.reshape(len(x), -1, k).argmin(axis=2)
    slot = nearest + np.arange(nearest.shape[1]) * k
    least = np.take_along_axis(distance, slot, axis=1)
    flat, size = slot.ravel(), len(centres)
    columns = [np.bincount(flat, minlength=size), np.bincount(flat, least.ravel(), size)]
    for j in range(x.shape[1]):
        columns.append(np.bincount(flat, np.repeat(x[:, j], slot.shape[1]), size))
    return np.stack(columns, axis=1)


def elbow(fits: KMeansFits) -> DataFrame:
    """Total within-cluster sum of squares per k."""
    return fits.centres.groupBy("k").agg(F.sum("withinss").alias("wss"))


def nearest_centre(features: Sequence[str], centres: Sequence[tuple[int, Sequence[float]]]) -> Column:
    """Label of the nearest centre as one JVM expression; on a tie the lower label."""
    options = []
    for label, centre in centres:
        squares = [(quoted(f) - F.lit(float(v))) * (quoted(f) - F.lit(float(v))) for f, v in zip(features, centre)]
        options.append(F.struct(sum(squares[1:], squares[0]).alias("d"), F.lit(label).alias("label")))
    return F.array_min(F.array(*options))["label"]


def centre_distances(
    df: DataFrame, id_column: str, features: Sequence[str], centres: Sequence[tuple[int, Sequence[float]]]
) -> DataFrame:
    """(id, cluster, distance): each row's Euclidean distance to every centre, k rows for a row."""
    cells = []
    for label, centre in centres:
        squares = [(quoted(f) - F.lit(float(v))) * (quoted(f) - F.lit(float(v))) for f, v in zip(features, centre)]
        cells.append(F.struct(F.lit(label).alias("cluster"), F.sqrt(sum(squares[1:], squares[0])).alias("distance")))
    return df.select(quoted(id_column), F.inline(F.array(*cells)))


def assign(
    df: DataFrame,
    features: Sequence[str],
    centres: Sequence[tuple[int, Sequence[float]]],
    name: str = "cluster",
) -> DataFrame:
    return df.withColumn(name, nearest_centre(features, centres))


def cluster_wss(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Size and sum of squares around the mean per cluster, for labels from any source."""
    squares = [F.var_pop(quoted(f)) * F.count(quoted(f)) for f in features]
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), sum(squares[1:], squares[0]).alias("withinss")
    )
