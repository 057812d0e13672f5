"""Density clustering by cells, without listing the pairs of a crowded place.

Copies of one point become one weighted point. Points are put into cells so small that all
points of a cell are within eps of each other: a cell with min_pts points needs no distances at
all. Only points of thinner cells measure distances, first to the boxes around neighbouring
cells, and point by point only where a box straddles the radius; a cell takes part in that with
fewer than min_pts points, so the work stays proportional to the table. Clusters are components
of cells, not of points. Two crowded cells are compared by halving their boxes until each pair
of parts is surely within or beyond the radius.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.nulls import complete_rows
from panelwright.functions.numbering import number_in_order
from panelwright.operators.columns import quoted
from panelwright.operators.graph import components
from panelwright.operators.grid import GRID_DIMENSIONS, around, largest_gap, least_gap, selective, squared
from panelwright.operators.joins import left_join
from panelwright.session import materialise, spread

# Two cells are compared point by point up to this product of their sizes, else by halving.
PAIR_BUDGET = 10_000
# Halving beyond this depth would exceed the range of the cell numbers.
DEEPEST = 40
COMPARISONS_PER_TASK = 500_000
GAPS_PER_TASK = 2_000_000
# Settings of a sweep that are worked on at the same time.
SETTINGS_AT_ONCE = 4


def distance_pairs(
    df: DataFrame, id_column: str, features: Sequence[str], within: float, *, invalid: str = "error"
) -> DataFrame:
    """(id_a, id_b, distance) of all pairs up to a distance, id_a < id_b.

    The list is as long as the answer, which grows with the square of a crowd: for a look at a
    few hundred entities. For large tables see kmeans.centre_distances.
    """
    d = min(len(features), GRID_DIMENSIONS)
    xs = [f"x{i}" for i in range(len(features))]
    rows = df.select(quoted(id_column).alias("id"), *[quoted(f).cast("double").alias(x) for f, x in zip(features, xs)])
    rows = complete_rows(rows, xs, invalid)
    cells = [F.floor(F.col(f"x{i}") / F.lit(within)) for i in range(d)]
    names = [f"c{i}" for i in range(d)]
    a = around(rows, cells, names)
    a = a.select(*names, *[F.col(c).alias(f"{c}_a") for c in rows.columns])
    b = rows.select(*[c.alias(n) for c, n in zip(cells, names)], *[F.col(c).alias(f"{c}_b") for c in rows.columns])
    gap = squared([F.col(f"x{i}_a") - F.col(f"x{i}_b") for i in range(len(features))])
    return (
        a.join(b, names)
        .filter((F.col("id_a") < F.col("id_b")) & (gap <= F.lit(within * within)))
        .select("id_a", "id_b", F.sqrt(gap).alias("distance"))
    )


def dbscan(
    df: DataFrame,
    id_column: str,
    features: Sequence[str],
    eps: float,
    min_pts: int,
    *,
    border_points: bool = True,
    invalid: str = "error",
) -> DataFrame:
    """(id, cluster, is_core): clusters 1, 2 ... in the order of their smallest core id, noise 0.

    A point with min_pts points within eps, itself counted, is a core point. A border point
    joins the first of the clusters in reach.
    """
    rows = _rows(df, id_column, features, invalid, eps)
    return _labels(rows, _distinct(rows), id_column, len(features), eps, min_pts, border_points)


def dbscan_sweep(
    df: DataFrame, id_column: str, features: Sequence[str], grid: Sequence[tuple[float, int]], *, invalid: str = "error"
) -> DataFrame:
    """Sizes per (eps, min_pts) and cluster: (eps, min_pts, cluster, size, cores)."""
    rows = _rows(df, id_column, features, invalid, max((eps for eps, _ in grid), default=1.0))
    points = _distinct(rows)

    def counted(setting: tuple[float, int]) -> DataFrame:
        eps, min_pts = setting
        labels = _labels(rows, points, id_column, len(features), eps, min_pts, True)
        sizes = labels.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("size"), F.count_if("is_core").alias("cores")
        )
        return sizes.select(F.lit(float(eps)).alias("eps"), F.lit(min_pts).alias("min_pts"), "cluster", "size", "cores")

    # A setting is a row of small jobs that leave most cores idle, and none waits for another setting.
    with ThreadPoolExecutor(SETTINGS_AT_ONCE) as pool:  # each with local properties of its own
        runs = [pool.submit(inheritable_thread_target(df.sparkSession)(counted), setting) for setting in grid]
        sizes = [run.result() for run in runs]
    return reduce(DataFrame.unionByName, sizes) if sizes else None


def _rows(df, id_column, features, invalid, eps):
    """Stored points; their coordinates are in the order of how well they part the points."""
    xs = [f"x{i}" for i in range(len(features))]
    rows = df.select(quoted(id_column).alias("id"), *[quoted(f).cast("double").alias(x) for f, x in zip(features, xs)])
    stored = materialise(complete_rows(rows, xs, invalid), "points")
    return stored.select("id", *[F.col(x).alias(n) for x, n in zip(selective(stored, xs, eps), xs)])


def _distinct(rows: DataFrame) -> DataFrame:
    xs = [c for c in rows.columns if c != "id"]
    collapsed = rows.groupBy(*xs).agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))
    return materialise(collapsed, "distinct-points")


def _box(xs: Sequence[str]) -> list[Column]:
    return [f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, f in (("lo", F.min), ("hi", F.max))]


def _bounds(d: int, name: str, side: str = "") -> list[Column]:
    return [F.col(f"{name}{i}{side}") for i in range(d)]


def _near(left: DataFrame, right: DataFrame, d: int, eps: float, side: float, once: str | None = None) -> DataFrame:
    """Pairs of boxes within eps, columns suffixed _a and _b, with squared gaps `least` and `largest`.

    Boxes are at most `side` long, so the low corners of two of them in reach differ by at most
    eps + side in each dimension and lie in adjacent cells of that width. The left boxes are divided
    by the gaps to measure, which grow with the crowd around them and not with their own number. Of
    the two orders of a pair only that with the smaller `once` on the left is measured.
    """
    width, g = eps + side, min(d, GRID_DIMENSIONS)
    names = [f"g{i}" for i in range(g)]
    corner = [F.floor(F.col(f"lo{i}") / F.lit(width)) for i in range(g)]
    found = right.select(*[c.alias(n) for c, n in zip(corner, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("there"))
    searched = left.groupBy(*[c.alias(f"{n}_own") for c, n in zip(corner, names)]).agg(F.count(F.lit(1)).cast("double").alias("here"))
    searched = around(searched, [F.col(f"{n}_own") for n in names], names)
    work = searched.join(found, names).agg(F.sum(F.col("here") * F.col("there"))).first()[0] or 0.0
    a = around(spread(left, work, GAPS_PER_TASK), corner, names).select(*names, *[F.col(c).alias(f"{c}_a") for c in left.columns])
    b = right.select(*[c.alias(n) for c, n in zip(corner, names)], *[F.col(c).alias(f"{c}_b") for c in right.columns])
    bounds = (_bounds(d, "lo", "_a"), _bounds(d, "hi", "_a"), _bounds(d, "lo", "_b"), _bounds(d, "hi", "_b"))
    pairs = a.join(b, names)
    if once:
        pairs = pairs.filter(F.col(f"{once}_a") < F.col(f"{once}_b"))
    return (
        pairs.drop(*names)
        .withColumn("least", least_gap(*bounds))
        .filter(F.col("least") <= F.lit(eps * eps))
        .withColumn("largest", largest_gap(*bounds))
    )


def _labels(rows, points, id_column, d, eps, min_pts, border_points) -> DataFrame:
    xs = [f"x{i}" for i in range(d)]
    limit = F.lit(eps * eps)
    # A hair under eps / sqrt(d), so that the diagonal of a cell is under eps after rounding too.
    side = eps / d**0.5 * (1 - 1e-9)

    celled = points.withColumn("cell", F.array(*[F.floor(F.col(x) / F.lit(side)) for x in xs]))
    cells = celled.groupBy("cell").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), *_box(xs))
    cells = materialise(cells, "cells")
    crowd = cells.select(F.col("cell").alias("own_cell"), F.col("w").alias("cell_w"), F.col("n").alias("cell_n"))
    celled = left_join(celled, crowd, [("cell", "own_cell")])

    # Points of thin cells, as boxes without extent, against the boxes of the cells around.
    thin = celled.filter(F.col("cell_w") < min_pts)
    probes = thin.select("pid", "cell", "cell_w", *[F.col(x).alias(f"{b}{i}") for i, x in enumerate(xs) for b in ("lo", "hi")])
    near = _near(probes, cells.select("cell", "w", *_corner_names(d)), d, eps, side)
    near = near.filter("cell_a != cell_b").select(
        "pid_a", "cell_w_a", "cell_b", "w_b", (F.col("largest") <= limit).alias("inside"),
        *[F.col(f"lo{i}_a").alias(f"y{i}") for i in range(d)],
    )
    near = materialise(near, "near-cells")
    counted = near.groupBy("pid_a", "cell_w_a").agg(F.sum(F.when(F.col("inside"), F.col("w_b")).otherwise(0)).alias("sure"))
    open_ids = counted.filter(F.col("cell_w_a") + F.col("sure") < min_pts).select("pid_a")
    measured = (
        near.filter("not inside")
        .join(open_ids, "pid_a", "left_semi")
        .join(celled.select(F.col("cell").alias("cell_b"), "w", *xs), "cell_b")
        .filter(squared([F.col(x) - F.col(f"y{i}") for i, x in enumerate(xs)]) <= limit)
        .groupBy("pid_a")
        .agg(F.sum("w").alias("hits"))
    )
    others = counted.join(measured, "pid_a", "left").select(
        F.col("pid_a").alias("pid"), (F.col("sure") + F.coalesce("hits", F.lit(0))).alias("others")
    )
    weight = F.col("cell_w") + F.coalesce("others", F.lit(0))
    thick = celled.filter(F.col("cell_w") >= min_pts).withColumn("is_core", F.lit(True))
    judged = thin.join(others, "pid", "left").withColumn("is_core", weight >= min_pts).drop("others")
    judged = materialise(thick.unionByName(judged.select(*thick.columns)), "core-points")

    cores = judged.filter("is_core")
    core_cells = cores.groupBy("cell").agg(F.min("pid").alias("node"), F.max("cell_n").alias("n"), *_box(xs))
    core_cells = materialise(core_cells, "core-cells")
    edges = _links(cores, core_cells, d, eps, side)
    roots = components(core_cells.select("node"), edges)
    rooted = materialise(
        core_cells.join(roots, "node").select("cell", "root", *_corner_names(d)), "rooted-cells"
    )
    numbers = number_in_order(rooted.select("root").distinct(), [F.col("root")], "cluster")

    cell_root = rooted.select(F.col("cell").alias("root_cell"), "root")
    labelled = left_join(judged.filter("is_core"), cell_root, [("cell", "root_cell")]).select(*xs, "is_core", "root")
    if border_points:
        edge_points = judged.filter("not is_core")
        reach = _border_roots(edge_points, near, cores, rooted, d, limit)
        borders = edge_points.join(reach, "pid").select(*xs, "is_core", "root")
        labelled = labelled.unionByName(borders)
    named = labelled.join(numbers, "root").select(
        *[F.col(x).alias(f"{x}_key") for x in xs], "is_core", F.col("cluster").cast("int").alias("cluster")
    )
    named = materialise(named, "labelled-points")
    joined = left_join(rows, named, [(x, f"{x}_key") for x in xs])
    return joined.select(
        F.col("id").alias(id_column),
        F.coalesce("cluster", F.lit(0)).alias("cluster"),
        F.coalesce("is_core", F.lit(False)).alias("is_core"),
    )


def _corner_names(d: int) -> list[str]:
    return [f"{n}{i}" for i in range(d) for n in ("lo", "hi")]


def _border_roots(edge_points, near, cores, rooted, d, limit) -> DataFrame:
    """(pid, root): the smallest root among the core points within eps."""
    here = edge_points.join(rooted.select("cell", "root"), "cell").select("pid", "root")
    target = rooted.select(F.col("cell").alias("cell_b"), "root", *_corner_names(d))
    beside = near.join(edge_points.select(F.col("pid").alias("pid_a")), "pid_a", "left_semi").join(target, "cell_b")
    at = [F.col(f"y{i}") for i in range(d)]
    bounds = (at, at, _bounds(d, "lo"), _bounds(d, "hi"))
    beside = beside.withColumn("inside", largest_gap(*bounds) <= limit).filter(least_gap(*bounds) <= limit)
    sure = beside.filter("inside").select(F.col("pid_a").alias("pid"), "root")
    xs = [f"x{i}" for i in range(d)]
    met = (
        beside.filter("not inside")
        .join(cores.select(F.col("cell").alias("cell_b"), *xs), "cell_b")
        .filter(squared([F.col(x) - y for x, y in zip(xs, at)]) <= limit)
        .select(F.col("pid_a").alias("pid"), "root")
    )
    return here.union(sure).union(met).groupBy("pid").agg(F.min("root").alias("root"))


def _links(cores: DataFrame, core_cells: DataFrame, d: int, eps: float, side: float) -> DataFrame:
    """Edges (a, b) between cells that hold core points within eps of each other."""
    limit = F.lit(eps * eps)
    boxes = core_cells.select("node", "cell", "n", *_corner_names(d))
    pairs = _near(boxes, boxes, d, eps, side, once="node")
    pairs = pairs.withColumn("inside", F.col("largest") <= limit)
    pairs = materialise(pairs.select("node_a", "node_b", "cell_a", "cell_b", "n_a", "n_b", "inside"), "cell-pairs")
    edges = pairs.filter("inside").select("node_a", "node_b")

    few = (F.col("n_a") * F.col("n_b")) <= PAIR_BUDGET
    members = cores.filter(F.col("cell_n") <= PAIR_BUDGET)
    edges = edges.union(_point_links(pairs.filter(~F.col("inside") & few), members, ["cell"], d, limit))

    state = pairs.filter(~F.col("inside") & ~few).withColumns({"part_a": F.col("cell_a"), "part_b": F.col("cell_b")})
    state = state.select("node_a", "node_b", "cell_a", "cell_b", "part_a", "part_b")
    depth = 0
    while not state.isEmpty():
        depth += 1
        held = state.select(F.col("cell_a").alias("cell")).union(state.select("cell_b")).distinct()
        part = F.array(*[F.floor(F.col(f"x{i}") / F.lit(side) * F.lit(2.0**depth)) for i in range(d)])
        crowded = cores.join(held, "cell", "left_semi").withColumn("part", part)
        parts = crowded.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), *_box([f"x{i}" for i in range(d)]))
        parent = F.transform("part", lambda p: F.floor(p / 2))
        parts = materialise(parts.withColumn("parent", parent), "cell-parts")
        for end in ("a", "b"):
            table = parts.select(
                F.col("cell").alias(f"cell_{end}"), F.col("parent").alias(f"part_{end}"),
                F.col("part").alias(f"next_{end}"), F.col("n").alias(f"n_{end}"),
                *[F.col(c).alias(f"{c}_{end}") for c in _corner_names(d)],
            )
            state = state.join(table, [f"cell_{end}", f"part_{end}"])
        bounds = (_bounds(d, "lo", "_a"), _bounds(d, "hi", "_a"), _bounds(d, "lo", "_b"), _bounds(d, "hi", "_b"))
        state = state.filter(least_gap(*bounds) <= limit).withColumn("inside", largest_gap(*bounds) <= limit)
        state = state.select(
            "node_a", "node_b", "cell_a", "cell_b", F.col("next_a").alias("part_a"), F.col("next_b").alias("part_b"),
            "n_a", "n_b", "inside",
        )
        state = materialise(state, "part-pairs")
        sure = materialise(state.filter("inside").select("node_a", "node_b").distinct(), "sure-links")
        state = materialise(state.filter("not inside").join(sure, ["node_a", "node_b"], "left_anti"), "open-pairs")
        few = (F.col("n_a") * F.col("n_b") <= PAIR_BUDGET) | F.lit(depth >= DEEPEST)
        met = materialise(_point_links(state.filter(few), crowded, ["cell", "part"], d, limit), "met-links")
        edges = edges.union(sure).union(met)
        state = state.filter(~few).join(met, ["node_a", "node_b"], "left_anti")
        state = materialise(state.select("node_a", "node_b", "cell_a", "cell_b", "part_a", "part_b"), "open-pairs")
    return edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _point_links(pairs: DataFrame, members: DataFrame, keys: list[str], d: int, limit: Column) -> DataFrame:
    """Pairs of places that hold two points within the limit, each compared point by point."""
    work = pairs.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
    joined = spread(pairs, work, COMPARISONS_PER_TASK)
    for end in ("a", "b"):
        table = members.select(
            *[F.col(k).alias(f"{k}_{end}") for k in keys], *[F.col(f"x{i}").alias(f"x{i}_{end}") for i in range(d)]
        )
        joined = joined.join(table, [f"{k}_{end}" for k in keys])
    gap = squared([F.col(f"x{i}_a") - F.col(f"x{i}_b") for i in range(d)])
    return joined.filter(gap <= limit).select("node_a", "node_b").distinct()
