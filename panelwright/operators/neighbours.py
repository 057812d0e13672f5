"""Nearest entities, exactly, by a tree of pivots and the triangle inequality.

Copies of one point become one point. The points are dealt to the nearest of a few pivots drawn from
them, and crowded cells are dealt again, until no cell holds more than CELL points; to spread
outliers, the point farthest from a cell's pivot is always one of its new pivots. Every cell knows
its pivot, its radius, the box around it and its number of points.

Inside its own cell each point finds its m nearest, which bounds how far the true ones can be.
Pairs of cells are then walked down the tree together: a pair stays only while the distance of the
pivots less both radii, and the gap between the boxes around the cells, are within the bound of the
first cell, and a bound is lowered where cells of more than m points together lie wholly nearer. What
is left are the cells that a point must still look into, and there only the points whose distance to
the pivot differs from its own by no more than its bound.

With missing coordinates, see `partners_with_missing`: rows are taken in classes by what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.nulls import complete_rows
from panelwright.operators.columns import quoted
from panelwright.operators.grid import GRID_DIMENSIONS, largest_gap, least_gap, squared
from panelwright.operators.joins import left_join
from panelwright.session import materialise, materialise_counted

CELL = 256  # points of a cell that is not dealt again
FAN = 16  # pivots that a crowded cell is dealt to, beside its farthest point
SLACK = 1e-9  # part of the distances that rounding may have moved a bound by
POINTS_PER_TASK = 5_000  # points that look for others in their own cell
PROBES = 4096  # points that look into another cell at once
PAIRS_PER_TASK = 8_000_000


def nearest(df: DataFrame, id_column: str, features: Sequence[str], m: int = 5, *, invalid: str = "error") -> DataFrame:
    """(id, rank, neighbour, distance): the m nearest other entities of each, by Euclidean distance.

    Ties go to the smaller id. Where there are fewer than m others, all are listed. The result has at
    most m rows an entity. Rows with a missing value fail the job, or leave with invalid="skip".
    """
    d = len(features)
    xs = [f"x{i}" for i in range(d)]
    # Adding zero turns a negative zero into a positive one.
    values = [(quoted(f).cast("double") + F.lit(0.0)).alias(x) for f, x in zip(features, xs)]
    rows = materialise(complete_rows(df.select(quoted(id_column).alias("id"), *values), xs, invalid), "entities")
    first = F.row_number().over(Window.partitionBy(*xs).orderBy("id"))
    copies = rows.withColumn("nth", first).filter(F.col("nth") <= m + 1).groupBy(*xs).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = materialise(copies.select(F.col("ids")[0].alias("pid"), "ids", *xs), "distinct-points")
    kind = dict(points.dtypes)["pid"]

    leaves, levels = _tree(points.select("pid", *xs), xs)
    own = materialise(_inside_cells(leaves, xs, m, kind, points.count() // POINTS_PER_TASK), "cell-neighbours")
    pairs = _cell_pairs(levels, own, m, d)

    probe = own.select("node", "pid", "theta", *[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)])
    probe = probe.join(pairs, "node")
    to_pivot = F.sqrt(squared([F.col(f"y{i}") - F.col("pivot")[i] for i in range(d)]))
    probe = probe.withColumn("gap", to_pivot).withColumn("within", F.least("theta", "bound") + F.lit(SLACK) * (F.col("gap") + F.col("radius")))
    point = [F.col(f"y{i}") for i in range(d)]
    beside = least_gap(point, point, *[[F.col(c)[i] for i in range(d)] for c in ("low", "high")])
    probe = probe.filter((F.col("gap") - F.col("radius") <= F.col("within")) & (beside <= F.col("within") * F.col("within")))
    probe = probe.select("other", "pid", "gap", "within", *[f"y{i}" for i in range(d)])
    there = own.select("node", F.col("pid").alias("near"), "dp", *xs)
    met = _across_cells(materialise(probe, "probes"), there, xs, m, kind)

    listed = own.select("pid", F.inline("nearest")).unionByName(met)
    listed = listed.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy("d2", "near"))).filter(F.col("nth") <= m)
    ids = points.select(F.col("pid").alias("near"), "ids")
    itself = points.select(F.col("pid"), F.lit(0.0).alias("d2"), "ids")
    listed = listed.join(ids, "near").select("pid", "d2", "ids").unionByName(itself)
    entries = listed.select("pid", F.explode(F.transform("ids", lambda i: F.struct(F.col("d2").alias("d2"), i.alias("id")))).alias("entry"))
    table = entries.groupBy("pid").agg(F.slice(F.array_sort(F.collect_list("entry")), 1, m + 1).alias("entries"))
    table = table.join(points.select("pid", *[F.col(x).alias(f"{x}_key") for x in xs]), "pid").drop("pid")
    found = left_join(rows, table, [(x, f"{x}_key") for x in xs])
    others = F.slice(F.filter("entries", lambda e: e["id"] != F.col("id")), 1, m)
    found = found.select("id", F.posexplode(others).alias("place", "entry"))
    return found.select(
        F.col("id").alias(id_column), (F.col("place") + 1).alias("rank"), F.col("entry.id").alias("neighbour"), F.sqrt("entry.d2").alias("distance")
    )


def _tree(points: DataFrame, xs: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their cell and their distance to its pivot, and the table of cells of each level."""
    place = F.array(*xs)
    pivots = points.agg(F.min_by(place, "pid").alias("p")).select(F.lit("").alias("node"), F.array("p").alias("pivots"))
    state, settled, levels = points.withColumns({"node": F.lit(""), "dp": F.lit(0.0)}), [], []
    while True:
        dealt = state.drop("dp").join(pivots, "node")
        gaps = F.transform("pivots", lambda p, i: F.struct(squared([F.col(x) - p[j] for j, x in enumerate(xs)]).alias("d2"), i.alias("k")))
        dealt = dealt.withColumn("best", F.array_min(gaps))
        dealt = dealt.select(
            "pid", *xs, F.concat_ws(".", "node", F.col("best.k").cast("string")).alias("node"), F.sqrt("best.d2").alias("dp")
        )
        dealt = materialise(dealt, "dealt-points")
        centres = pivots.select("node", F.posexplode("pivots").alias("k", "pivot"))
        centres = centres.select(F.col("node").alias("parent"), F.concat_ws(".", "node", F.col("k").cast("string")).alias("node"), "pivot")
        sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("dp").alias("radius"), *_box(xs))
        cells, crowded = materialise_counted(sizes.join(centres, "node"), "cells", F.col("n") > CELL)
        levels.append(cells.withColumn("leaf", F.col("n") <= CELL))
        large = cells.filter(F.col("n") > CELL).select("node")
        settled.append(dealt.join(large, "node", "left_anti") if crowded else dealt)
        if not crowded:
            break
        state = dealt.join(large, "node", "left_semi")
        drawn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("pid", F.lit(len(levels))), "pid"))
        drawn = state.withColumn("nth", drawn).filter(F.col("nth") <= FAN).select("node", place.alias("p"))
        far = state.groupBy("node").agg(F.max_by(place, F.struct("dp", "pid")).alias("p"))
        pivots = drawn.unionByName(far).groupBy("node").agg(F.array_sort(F.collect_set("p")).alias("pivots"))
        pivots = materialise(pivots, "pivots")
    leaves = settled[0]
    for part in settled[1:]:
        leaves = leaves.unionByName(part)
    return leaves, levels


def _box(xs: list[str]) -> list[Column]:
    return [F.array(*map(f, xs)).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]


def _inside_cells(leaves: DataFrame, xs: list[str], m: int, kind: str, tasks: int) -> DataFrame:
    """Each point's m nearest in its own cell; theta is the distance of the last, infinite if there are fewer."""

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("pid", kind="stable").reset_index(drop=True)
        n = len(cell)
        d2 = np.zeros((n, n))
        for x in xs:
            v = cell[x].to_numpy()
            d2 += (v[:, None] - v[None, :]) ** 2
        np.fill_diagonal(d2, np.inf)
        order = np.argsort(d2, axis=1, kind="stable")[:, : min(m, n - 1)]
        gaps, names = np.take_along_axis(d2, order, axis=1), cell["pid"].to_numpy()
        cell["theta"] = np.sqrt(gaps[:, m - 1]) if n > m else np.inf
        cell["nearest"] = [[{"near": names[j], "d2": g} for j, g in zip(o, row)] for o, row in zip(order, gaps)]
        return cell[["node", "pid", *xs, "dp", "theta", "nearest"]]

    columns = ", ".join(f"{x} double" for x in xs)
    schema = f"node string, pid {kind}, {columns}, dp double, theta double, nearest array<struct<near:{kind},d2:double>>"
    leaves = leaves.select("node", "pid", *xs, "dp")
    # Adaptive execution would put the few bytes of all cells into one task.
    leaves = leaves.repartition(tasks, "node") if tasks > 1 else leaves
    return leaves.groupBy("node").applyInPandas(search, schema)


def _across_cells(probe: DataFrame, there: DataFrame, xs: list[str], m: int, kind: str) -> DataFrame:
    """(pid, near, d2): of each cell that a point looks into, at most the m nearest points within its bound.

    A cell meets the points that look into it in portions, so that no crowd around a cell is one group.
    """

    def search(points: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("near", kind="stable")
        names, kept = cell["near"].to_numpy(), []
        for low in range(0, len(points), PROBES):
            part = points.iloc[low : low + PROBES]
            gap, within = part["gap"].to_numpy()[:, None], part["within"].to_numpy()[:, None]
            d2 = np.zeros((len(part), len(cell)))
            for i, x in enumerate(xs):
                d2 += (cell[x].to_numpy()[None, :] - part[f"y{i}"].to_numpy()[:, None]) ** 2
            d2[(np.abs(gap - cell["dp"].to_numpy()[None, :]) > within) | (d2 > within * within)] = np.inf
            some = np.flatnonzero(np.isfinite(d2).any(axis=1))
            order = np.argsort(d2[some], axis=1, kind="stable")[:, :m]
            gaps = np.take_along_axis(d2[some], order, axis=1)
            row, place = np.nonzero(np.isfinite(gaps))
            pids = part["pid"].to_numpy()[some[row]]
            kept.append(pd.DataFrame({"pid": pids, "near": names[order[row, place]], "d2": gaps[row, place]}))
        return pd.concat(kept) if kept else pd.DataFrame({"pid": names[:0], "near": names[:0], "d2": np.empty(0)})

    sizes = probe.groupBy("other").agg(F.count(F.lit(1)).alias("probes"))
    sizes = sizes.join(there.groupBy(F.col("node").alias("other")).agg(F.count(F.lit(1)).alias("n")), "other")
    sizes = sizes.select("other", F.ceil(F.col("probes") / PROBES).alias("portions"), (F.col("probes") * F.col("n")).cast("double").alias("pairs"))
    sizes = materialise(sizes, "cell-probes")
    tasks = int(sizes.agg(F.sum("pairs")).first()[0] or 0) // PAIRS_PER_TASK + 1
    keys = ["other", "portion"]
    probe = probe.join(sizes.select("other", "portions"), "other").withColumn("portion", F.pmod(F.xxhash64("pid"), "portions")).drop("portions")
    portions = F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion")
    there = there.withColumnRenamed("node", "other").join(sizes.select("other", portions), "other")
    probe, there = (t.repartition(tasks, *keys) for t in (probe, there))
    found = probe.groupBy(*keys).cogroup(there.groupBy(*keys))
    return found.applyInPandas(search, f"pid {kind}, near {kind}, d2 double")


def _cell_pairs(levels: list[DataFrame], own: DataFrame, m: int, d: int) -> DataFrame:
    """(node, other, bound, pivot, radius, low, high): the other cells that points of a cell must look into."""
    spread = own.groupBy("node").agg(F.max("theta").alias("theta"))
    parts = F.split("node", r"\.")
    above = F.explode(F.sequence(F.lit(2), F.size(parts)))
    upward = spread.select(parts.alias("parts"), "theta", above.alias("size"))
    thetas = upward.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("size")), ".").alias("node")).agg(F.max("theta").alias("theta"))
    cells = levels[0]
    for level in levels[1:]:
        cells = cells.unionByName(level)
    cells = materialise(cells.join(thetas, "node"), "cells")
    kept = ["n", "radius", "pivot", "theta", "low", "high"]
    steps = cells.filter("leaf").select(F.col("node").alias("from"), "node", *kept)
    steps = steps.unionByName(cells.select(F.col("parent").alias("from"), "node", *kept))
    root = cells.filter("parent = ''").select(F.col("node").alias("node_a"), F.col("node").alias("node_b"), F.lit(float("inf")).alias("bound"))
    pairs = root
    gap = F.sqrt(F.aggregate(F.zip_with("pivot_a", "pivot_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    for _ in range(max(1, len(levels) - 1)):
        for end in ("a", "b"):
            table = steps.select(F.col("from").alias(f"node_{end}"), F.col("node").alias(f"next_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in kept])
            pairs = pairs.join(table, f"node_{end}")
        both = F.col("radius_a") + F.col("radius_b")
        boxes = [[F.col(f"{c}_{end}")[i] for i in range(d)] for end in ("a", "b") for c in ("low", "high")]
        beyond = F.least(F.col("gap") + both, F.sqrt(largest_gap(*boxes)))
        # The cells that lie nearest as a whole, until they hold more than m points together.
        nearer = Window.partitionBy("next_a").orderBy("beyond").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = pairs.withColumn("gap", gap).withColumn("beyond", beyond).withColumn("held", F.sum("n_b").over(nearer))
        full = F.min(F.when(F.col("held") > m, F.col("beyond"))).over(Window.partitionBy("next_a"))
        pairs = pairs.withColumn("bound", F.least("bound", "theta_a", full))
        limit = F.col("bound") + F.lit(SLACK) * (F.col("gap") + both)
        pairs = pairs.filter((F.col("gap") - both <= limit) & (F.sqrt(least_gap(*boxes)) <= limit))
        shape = [F.col(f"{c}_b").alias(c) for c in ("pivot", "radius", "low", "high")]
        last = materialise(pairs.select(F.col("next_a").alias("node_a"), F.col("next_b").alias("node_b"), "bound", *shape), "cell-pairs")
        pairs = last.select("node_a", "node_b", "bound")
    last = last.filter("node_a <> node_b").withColumnsRenamed({"node_a": "node", "node_b": "other"})
    return last.select("node", "other", "bound", "pivot", "radius", "low", "high")


def partners_with_missing(df: DataFrame, id_column: str, features: Sequence[str], within: float) -> DataFrame:
    """(id, present, comparable, near, nearest, distance) of every entity, missing coordinates allowed.

    The distance of two entities is measured over the coordinates that both have and scaled up to all
    of them: sqrt(all / common * sum of squares). Two entities without a common coordinate have
    none. `present` counts an entity's coordinates, `comparable` the other entities with a common
    one, `near` those within the distance; `nearest` is the nearest of these (the smaller id on a
    tie), null if there is none. NaN counts as missing. Ids must be unique.

    Entities are classed by which coordinates they have, at most 2 ** features classes, and copies
    of one point in a class become one weighted point. Each pair of classes shares its own
    coordinates, so it has a grid of its own on up to three of them, with a width scaled to it; all
    pairs of classes are joined at once on class, partner's class and cell. Pairs are met twice, for
    the counts and least distances and then for the ids at these, so that no pair is sorted or
    shuffled; the second time only the cells no farther than the nearest partner are looked into.
    """
    d = len(features)
    xs = [f"x{i}" for i in range(d)]
    # Adding zero turns a negative zero into a positive one.
    values = [(F.nanvl(quoted(f).cast("double"), F.lit(None).cast("double")) + F.lit(0.0)).alias(x) for f, x in zip(features, xs)]
    rows = df.select(quoted(id_column).alias("id"), *values)
    mask = F.lit(0)
    for i, x in enumerate(xs):
        mask = mask + F.when(F.col(x).isNotNull(), 1 << i).otherwise(0)
    rows = materialise(rows.withColumn("own", mask.cast("int")), "entities")
    classes = {r["own"]: r["count"] for r in rows.groupBy("own").count().collect()}  # at most 2 ** d
    comparable = {a: sum(n for b, n in classes.items() if a & b) - int(a > 0) for a in classes}

    # A row without an id is nobody's partner. Missing coordinates are told by the class, so zeros can stand for them.
    placed = rows.filter(F.col("id").isNotNull() & (F.col("own") > 0))
    keys = ["own", *[f"k{i}" for i in range(d)]]
    placed = placed.select("id", "own", *[F.coalesce(x, F.lit(0.0)).alias(k) for x, k in zip(xs, keys[1:])], *xs)
    points = placed.groupBy(*keys).agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"), *[F.first(x).alias(x) for x in xs])
    points = materialise(points, "distinct-points")
    named = points.select("pid", "w", *[F.col(k).alias(f"{k}_key") for k in keys])
    members = materialise(left_join(placed.select("id", *keys), named, [(k, f"{k}_key") for k in keys], how="inner").select("id", "pid", "w"), "members")
    seconds = members.filter("w > 1 AND id <> pid").groupBy("pid").agg(F.min("id").alias("second"))

    heads = []
    for a in classes:
        for b in classes:
            if common := a & b:
                shared = [i for i in range(d) if common >> i & 1]
                heads.append((a, b, shared[:GRID_DIMENSIONS], within * (len(shared) / d) ** 0.5))
    heads = df.sparkSession.createDataFrame(heads, "own int, partner int, lead array<int>, width double")
    axis = F.transform("lead", lambda i: F.floor(F.get(F.array(*xs), i) / F.col("width")))
    filled = F.concat(axis, F.array_repeat(F.lit(0).cast("long"), GRID_DIMENSIONS - F.size("lead")))
    met = points.join(heads, "own").select("pid", "w", "own", "partner", "lead", "width", filled.alias("cell"), *xs)
    there = met.select(
        F.col("pid").alias("other"), F.col("w").alias("weight"), F.col("own").alias("partner"), F.col("partner").alias("own"),
        *[F.col("cell")[i].alias(f"c{i}") for i in range(GRID_DIMENSIONS)], *[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)],
    )
    squares = squared([F.coalesce(F.col(x) - F.col(f"y{i}"), F.lit(0.0)) for i, x in enumerate(xs)])
    common = F.bit_count(F.col("own").bitwiseAND(F.col("partner")))

    def partners(searching: DataFrame, nearer: bool) -> DataFrame:
        beside = F.lit(0.0)
        for i in range(GRID_DIMENSIONS):
            steps = F.when(F.size("lead") > i, F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0)))
            searching = searching.withColumn(f"step{i}", F.explode(steps)).withColumn(f"c{i}", F.col("cell")[i] + F.col(f"step{i}"))
            at, low = F.get(F.array(*xs), F.get("lead", F.lit(i))), F.col("cell")[i] * F.col("width")
            gap = F.when(F.col(f"step{i}") < 0, at - low).when(F.col(f"step{i}") > 0, low + F.col("width") - at).otherwise(F.lit(0.0))
            beside = beside + gap * gap
        if nearer:  # with room for the rounding of the cells' bounds
            reach = F.col("least") * F.col("least") * common / F.lit(float(d))
            room = F.lit(SLACK) * F.col("width") * F.col("width")
            searching = searching.filter(beside * F.lit(1 - SLACK) <= reach + room)
        searching = searching.select("pid", *["least"] * nearer, "own", "partner", *[f"c{i}" for i in range(GRID_DIMENSIONS)], *xs)
        pairs = searching.join(there, ["own", "partner", *[f"c{i}" for i in range(GRID_DIMENSIONS)]]).filter(F.col("pid") != F.col("other"))
        return pairs.withColumn("distance", F.sqrt(squares * F.lit(float(d)) / common)).filter(F.col("distance") <= within)

    found = partners(met, False).groupBy("pid").agg(F.sum("weight").alias("met"), F.min("distance").alias("least"))
    found = materialise(found, "least-distances")
    ids = partners(met.join(found.select("pid", "least"), "pid"), True).filter("distance = least").groupBy("pid").agg(F.min("other").alias("other"))
    found = found.join(ids, "pid")

    # Copies are partners at distance zero, as may be points of other classes.
    copy = F.when(F.col("w") > 1, F.when(F.col("id") == F.col("pid"), F.col("second")).otherwise(F.col("pid")))
    best = members.join(found, "pid", "left").join(seconds, "pid", "left").select(
        "id",
        (F.coalesce("met", F.lit(0)) + F.col("w") - 1).alias("near"),
        F.when(copy.isNull(), F.col("other")).when(F.col("least") == 0, F.least(copy, "other")).otherwise(copy).alias("other"),
        F.when(copy.isNull(), F.col("least")).otherwise(F.lit(0.0)).alias("distance"),
    )
    listed = rows.withColumns({"comparable": _looked_up("own", comparable), "present": F.bit_count(F.col("own")).cast("int")})
    joined = listed.select("id", "present", "comparable").join(best, "id", "left")
    return joined.select(
        F.col("id").alias(id_column), "present", "comparable", F.coalesce("near", F.lit(0)).alias("near"),
        F.col("other").alias("nearest"), "distance",
    )


def _looked_up(column: str, table: dict[int, int]) -> Column:
    entries = [F.lit(v).cast("long") for pair in table.items() for v in pair]
    return F.element_at(F.create_map(*entries), F.col(column).cast("long")) if entries else F.lit(0).cast("long")
