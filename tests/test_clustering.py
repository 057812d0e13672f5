import math
import random
import threading

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from panelwright.operators import compare, joins
from panelwright.operators import dbscan as db
from panelwright.operators import kmeans as km
from panelwright.operators import projection, ward
from panelwright.operators.graph import components


def frame(spark, points, names="abcdefgh"):
    d = points.shape[1]
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names[:d])), list(names[:d])


def blobs(seed, n=90, d=2, spread=0.4, centres=4):
    rng = np.random.default_rng(seed)
    at = rng.uniform(-4, 4, size=(centres, d))
    return at[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, d))


# --- k-means -----------------------------------------------------------------------------------


def test_kmeans_is_no_worse_than_single_starts(spark):
    points = blobs(1, centres=6, spread=1.0)
    df, names = frame(spark, points)
    fits = km.kmeans_sweep(df, "id", names, range(2, 6), starts=10)
    elbow = {r.k: r.wss for r in km.elbow(fits).collect()}
    assert sorted(elbow) == [2, 3, 4, 5]
    assert all(elbow[k + 1] <= elbow[k] * 1.001 for k in (2, 3, 4))
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    for seed in range(3):
        other = KMeans(k=4, seed=seed, maxIter=25, featuresCol="v").fit(vectors)
        assert elbow[4] <= other.summary.trainingCost * 1.001
    centres = fits.of(4)
    labelled = km.assign(df, names, centres)
    wss = {r.cluster: (r["size"], r.withinss) for r in km.cluster_wss(labelled, "cluster", names).collect()}
    table = {r.cluster: (r["size"], r.withinss) for r in fits.centres.filter("k = 4").collect()}
    assert sorted(wss) == [1, 2, 3, 4]
    for c in wss:
        assert wss[c][0] == table[c][0] and math.isclose(wss[c][1], table[c][1], rel_tol=1e-9)
    assert centres == sorted(centres, key=lambda c: c[1])


def test_kmeans_rejects_nulls_and_too_many_clusters(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 2.0)], "id long, a double")
    with pytest.raises(Exception, match="missing value in a"):
        km.kmeans_sweep(df, "id", ["a"], [2])
    assert km.elbow(km.kmeans_sweep(df, "id", ["a"], [2], invalid="skip")).first().wss == 0.0
    with pytest.raises(ValueError, match="3 clusters asked of 2"):
        km.kmeans_sweep(df, "id", ["a"], [3], invalid="skip")


def test_kmeans_draws_when_only_a_share_is_tried(spark, monkeypatch):
    monkeypatch.setattr(km, "CANDIDATES", 20)
    df, names = frame(spark, blobs(3))
    fits = km.kmeans_sweep(df, "id", names, [4], starts=5)
    assert fits.centres.count() == 4 and sum(r["size"] for r in fits.centres.collect()) == 90


# --- density -----------------------------------------------------------------------------------


def brute_dbscan(points, eps, min_pts):
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    near = gap <= eps
    core = near.sum(1) >= min_pts
    label, current = np.zeros(len(points), int), 0
    for i in range(len(points)):
        if core[i] and not label[i]:
            current += 1
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j]:
                    continue
                label[j] = current
                stack += [k for k in np.flatnonzero(near[j] & core) if not label[k]]
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else 0
    return label, core


@pytest.mark.parametrize(
    "seed, d, eps, min_pts", [(1, 2, 0.35, 4), (2, 2, 0.6, 6), (3, 3, 0.7, 4), (4, 5, 1.1, 3), (5, 2, 0.2, 3)]
)
def test_dbscan_matches_brute_force(spark, seed, d, eps, min_pts):
    points = blobs(seed, 150, d)
    points[20:26] = points[19]  # copies
    df, names = frame(spark, points)
    got = {r.id: (r.cluster, r.is_core) for r in db.dbscan(df, "id", names, eps, min_pts).collect()}
    label, core = brute_dbscan(points, eps, min_pts)
    assert got == {i: (int(l), bool(c)) for i, (l, c) in enumerate(zip(label, core))}


@pytest.mark.parametrize("seed, gap", [(1, 0.52), (2, 0.48), (3, 0.5)])
def test_crowded_cells_are_compared_by_halving(spark, monkeypatch, seed, gap):
    monkeypatch.setattr(db, "PAIR_BUDGET", 6)
    rng = np.random.default_rng(seed)
    left = rng.uniform(0, 0.3, size=(60, 2))
    right = left + [left[:, 0].max() + gap - left[:, 0].min(), 0.0]
    points = np.round(np.r_[left, right], 6)
    df, names = frame(spark, points)
    got = {r.id: r.cluster for r in db.dbscan(df, "id", names, 0.5, 3).collect()}
    label, _ = brute_dbscan(points, 0.5, 3)
    assert got == {i: int(l) for i, l in enumerate(label)}


def test_dbscan_does_not_depend_on_row_order_and_handles_noise_only(spark):
    points = blobs(8)
    df, names = frame(spark, points)
    a = {tuple(r) for r in db.dbscan(df, "id", names, 0.4, 4).collect()}
    b = {tuple(r) for r in db.dbscan(df.orderBy("b").repartition(3), "id", names, 0.4, 4).collect()}
    assert a == b
    alone = db.dbscan(df, "id", names, 1e-9, 4).collect()
    assert len(alone) == 90 and {r.cluster for r in alone} == {0}


def test_borders_can_be_noise_and_sweep_counts(spark):
    points = blobs(9, 80)
    df, names = frame(spark, points)
    label, core = brute_dbscan(points, 0.4, 5)
    strict = {r.id: r.cluster for r in db.dbscan(df, "id", names, 0.4, 5, border_points=False).collect()}
    assert strict == {i: int(l) if c else 0 for i, (l, c) in enumerate(zip(label, core))}
    sizes = {(r.eps, r.min_pts, r.cluster): (r["size"], r.cores) for r in db.dbscan_sweep(df, "id", names, [(0.4, 5)]).collect()}
    assert sizes == {(0.4, 5, int(c)): (int((label == c).sum()), int(core[label == c].sum())) for c in set(label)}


def test_distance_pairs(spark):
    points = blobs(10, 60, 4)
    df, names = frame(spark, points)
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    got = {(r.id_a, r.id_b): r.distance for r in db.distance_pairs(df, "id", names, 1.0).collect()}
    want = {(i, j): gap[i, j] for i in range(60) for j in range(i + 1, 60) if gap[i, j] <= 1.0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_components(spark):
    rng = np.random.default_rng(5)
    order = rng.permutation(200)
    chain = [(int(order[i]), int(order[i + 1])) for i in range(119)]  # one long path
    hub = [(int(order[150]), int(order[i])) for i in range(151, 180)]
    edges = spark.createDataFrame(chain + hub, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(200)], "node long")
    got = {r.node: r.root for r in components(nodes, edges).collect()}
    want = {int(n): int(n) for n in order}
    want.update({int(n): int(order[:120].min()) for n in order[:120]})
    want.update({int(n): int(order[150:180].min()) for n in order[150:180]})
    assert got == want
    none = components(nodes, edges.limit(0))
    assert none.filter("node != root").count() == 0


# --- Ward --------------------------------------------------------------------------------------


def greedy_ward(points):
    live = {i: (1, points[i], [i]) for i in range(len(points))}
    heights, steps = [], []
    while len(live) > 1:
        best = min(
            (math.sqrt(2 * a[0] * b[0] / (a[0] + b[0])) * float(np.linalg.norm(a[1] - b[1])), i, j)
            for i, a in live.items() for j, b in live.items() if i < j
        )
        h, i, j = best
        a, b = live.pop(i), live.pop(j)
        live[i] = (a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2])
        heights.append(h)
        steps.append([sorted(m[2]) for m in live.values()])
    return heights, steps


def partition(labels):
    groups = {}
    for i, c in labels.items():
        groups.setdefault(c, []).append(i)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("candidates", [ward.CANDIDATES, 150])
def test_ward_matches_the_greedy_tree(spark, monkeypatch, candidates):
    monkeypatch.setattr(ward, "CANDIDATES_PER_CLUSTER", 3)
    points = blobs(11, 60, 3)
    points[40:45] = points[39]  # copies
    df, names = frame(spark, points)
    tree = ward.ward_tree(df, "id", names, candidates=candidates)
    heights, steps = greedy_ward(points)
    rows = ward.numbered(tree).orderBy("step").collect()
    assert [r.step for r in rows] == list(range(1, 60))
    assert np.allclose([r.height for r in rows], heights, atol=1e-9)
    assert all(r.left < r.right for r in rows) and len({r.right for r in rows}) == 59
    for k in (1, 2, 4, 7):
        labels = {r.id: r.cluster for r in ward.cut(df, "id", tree, k).collect()}
        assert partition(labels) == sorted(sorted(g) for g in steps[60 - k - 1])
        firsts = [min(g) for g in partition(labels)]
        assert [labels[f] for f in sorted(firsts)] == list(range(1, k + 1))
    total = {}
    for r in ward.elbow(tree, range(1, 8)).collect():
        groups = steps[60 - r.k - 1]
        total[r.k] = sum(((points[g] - points[g].mean(0)) ** 2).sum() for g in groups)
        assert math.isclose(r.wss, total[r.k], rel_tol=1e-9)


def drawn(matrix, node):
    """Rows below a node from left to right."""
    order, todo = [], [node]
    while todo:
        at = todo.pop()
        if at < 0:
            order.append(-at)
        else:
            todo += reversed(matrix[at])
    return order


@pytest.mark.parametrize("shape", ["blobs", "chain"])
def test_ward_merge_matrix_and_leaf_order(spark, shape):
    points = blobs(13, 50, 2) if shape == "blobs" else np.array([(1.7**i, 0.0) for i in range(40)])
    if shape == "blobs":
        points[20:24] = points[3]  # copies
    n = len(points)
    df, names = frame(spark, points)
    tree = ward.ward_tree(df, "id", names)
    ids = sorted(r.id for r in df.collect())
    members = {-(i + 1): {v} for i, v in enumerate(ids)}
    matrix, joins = {}, {r.step: r for r in ward.numbered(tree).collect()}
    for r in ward.merge_matrix(df, "id", tree).orderBy("step").collect():
        assert r.first < r.second or (r.second < 0 and -r.first < -r.second)
        matrix[r.step] = (r.first, r.second)
        one, other = members.pop(r.first), members.pop(r.second)
        assert {min(one), min(other)} == {joins[r.step].left, joins[r.step].right}
        members[r.step] = one | other
    assert list(members) == [n - 1] and members[n - 1] == set(ids)
    place = {r.id: r.place for r in ward.leaf_order(df, "id", tree).collect()}
    assert [ids[i - 1] for i in drawn(matrix, n - 1)] == sorted(ids, key=place.get)
    assert sorted(place.values()) == list(range(1, n + 1))


def test_ward_order_of_one_row_and_of_none(spark):
    df, names = frame(spark, np.array([[1.0, 2.0]]))
    tree = ward.ward_tree(df, "id", names)
    assert [r.place for r in ward.leaf_order(df, "id", tree).collect()] == [1]
    none = df.limit(0)
    tree = ward.ward_tree(none, "id", names)
    assert ward.leaf_order(none, "id", tree).count() == 0 == ward.merge_matrix(none, "id", tree).count()


def test_ward_on_a_lattice_of_ties(spark):
    points = np.array([(x, y) for x in range(8) for y in range(8)], float)
    df, names = frame(spark, points)
    tree = ward.ward_tree(df, "id", names)
    assert tree.count() == 63 and tree.selectExpr("max(round)").first()[0] < 40
    total = ((points - points.mean(0)) ** 2).sum()
    assert math.isclose(tree.selectExpr("sum(height * height / 2)").first()[0], total, rel_tol=1e-9)


# --- projection --------------------------------------------------------------------------------


def test_projection(spark):
    points = blobs(12, 70, 4) * [1, 5, 0.2, 3]
    df, names = frame(spark, points)
    scores = projection.pca_projection(df, "id", names).orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy()
    z = (points - points.mean(0)) / points.std(0, ddof=1)
    _, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose((scores**2).sum(0), s[:2] ** 2) and abs((scores[:, 0] * scores[:, 1]).sum()) < 1e-9
    table = projection.loadings_table(df, names).collect()
    assert math.isclose(sum({r.component: r.share for r in table}.values()), 1.0)
    two = projection.pca_projection(df, "id", ["a", "c"]).orderBy("id").toPandas()
    assert np.allclose(two[["pc1", "pc2"]].to_numpy(), z[:, [0, 2]])


def test_ward_of_heavy_points_stays_within_its_budget(spark, monkeypatch):
    """Copies make heights far larger than distances; no cell may gather all clusters for that."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        rows += [(i * 400 + j, x, y) for j in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    seen, plain = [], ward._round

    def watched(probes, live, xs, radius, everything):
        m = live.count()
        if everything:
            seen.append((m * m, 2_000))
        else:
            seen.append((ward.crowd(live, xs, radius)[0], max(2_000, ward.CANDIDATES_PER_CLUSTER * m)))
        return plain(probes, live, xs, radius, everything)

    monkeypatch.setattr(ward, "_round", watched)
    tree = ward.ward_tree(df, "id", ["x", "y"], candidates=2_000)
    monkeypatch.undo()
    assert tree.count() == len(rows) - 1
    assert all(cost <= 3 * budget for cost, budget in seen), seen
    whole = ward.ward_tree(df, "id", ["x", "y"])
    heights = [sorted(r.height for r in t.filter("height > 0").collect()) for t in (tree, whole)]
    assert np.allclose(*heights)


def test_selective_columns_come_first(spark):
    from panelwright.operators import grid

    df = spark.range(1000).selectExpr("0.0D AS a", "id / 1.0D AS b", "floor(id / 10) * 1.0D AS c", "id % 2 * 1.0D AS d", "id * 7 % 1000 * 1.0D AS e")
    assert grid.selective(df, list("abcde"), 1.0) == ["b", "e", "c", "d", "a"]


def test_more_clusters_than_allowed(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double")
    tree = ward.ward_tree(df, "id", ["x"])
    for bad in (0, ward.MOST_CLUSTERS + 1):
        with pytest.raises(ValueError):
            ward.cut(df, "id", tree, bad)
        with pytest.raises(ValueError):
            ward.elbow(tree, [1, bad])


def test_dbscan_divides_boxes_by_the_gaps_they_measure(spark, monkeypatch):
    """In six features nearly every box meets every other, so few boxes can be much work."""
    rng = random.Random(6)
    rows = [(i, *[rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    names = [f"f{i}" for i in range(6)]
    works, spread = [], db.spread
    monkeypatch.setattr(db, "spread", lambda df, work, per_task: works.append(work / per_task) or spread(df, work, per_task))
    plain = sorted(map(tuple, db.dbscan(spark.createDataFrame(rows, ["id", *names]), "id", names, 1.3, 4).collect()))
    assert max(works) * 2_000_000 > 20 * len(rows)
    monkeypatch.setattr(db, "GAPS_PER_TASK", 1_000)
    works.clear()
    assert sorted(map(tuple, db.dbscan(spark.createDataFrame(rows, ["id", *names]), "id", names, 1.3, 4).collect())) == plain
    assert max(works) > 6


def written_records(plan):
    """Records that each shuffle of an executed plan wrote."""
    metric = plan.metrics().get("shuffleRecordsWritten")
    out = [metric.get().value()] if plan.nodeName() == "Exchange" and metric.isDefined() else []
    inner = [plan.plan()] if "QueryStage" in plan.nodeName() else []
    inner += [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else []
    children = plan.children()
    for p in inner + [children.apply(i) for i in range(children.size())]:
        out += written_records(p)
    return out


def test_ward_offers_are_reduced_in_the_task_that_searches(spark):
    """Candidates of one class are not sent to both ends, so that shuffles hold clusters and not candidates."""
    rng, n = random.Random(3), 200
    live = spark.createDataFrame([(i, 1.0, rng.random(), rng.random()) for i in range(n)], "rep long, size double, x0 double, x1 double")
    live = ward.materialise(live.coalesce(1), "clusters")
    for everything in (True, False):
        step = ward._round(live.repartition(8), live, ["x0", "x1"], 1.0, everything)
        assert len(step.collect()) < n
        assert 0 < max(written_records(step._jdf.queryExecution().executedPlan())) <= 3 * n


def test_settings_of_a_sweep_do_not_wait_for_each_other(spark, monkeypatch):
    draw = random.Random(8)
    df = spark.createDataFrame([(i, draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(80)], "id bigint, a double, b double")
    grid = [(0.3, 3), (0.5, 4), (0.3, 5)]
    expected = {}
    for eps, min_pts in grid:
        for r in db.dbscan(df, "id", ["a", "b"], eps, min_pts).collect():
            size, cores = expected.get((eps, min_pts, r["cluster"]), (0, 0))
            expected[eps, min_pts, r["cluster"]] = size + 1, cores + r["is_core"]
    together, real = threading.Barrier(len(grid), timeout=120), db._labels
    monkeypatch.setattr(db, "_labels", lambda *a: together.wait() >= 0 and real(*a))
    found = db.dbscan_sweep(df, "id", ["a", "b"], grid).collect()
    assert {(r["eps"], r["min_pts"], r["cluster"]): (r["size"], r["cores"]) for r in found} == expected


def test_joins_of_many_rows_are_not_left_to_the_estimate(spark, monkeypatch):
    """With few rows Spark's own choice would be to broadcast them all."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    plans = {}

    def noted(store, name):
        def run(df, label, *rest):
            plans.setdefault(name or label, []).append(text(df))
            return store(df, label, *rest)

        return run

    table = spark.createDataFrame([(i, float(i * i % 37), float(i % 5)) for i in range(60)], "id long, x double, y double")
    xs = ["x", "y"]

    def all_of_it():
        tree = ward.ward_tree(table, "id", xs, candidates=100)
        labels = ward.cut(table, "id", tree, 3)
        both = compare.attach_labels(table, labels, "id")
        return both, [sorted(map(tuple, d.collect())) for d in (ward.numbered(tree), both, ward.leaf_order(table, "id", tree))]

    _, want = all_of_it()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(ward, "write_counted", noted(ward.write_counted, "round"))
    monkeypatch.setattr(ward, "materialise_counted", noted(ward.materialise_counted, None))
    both, got = all_of_it()
    assert got == want
    wide = table.select("id", "x").withColumnRenamed("x", "z")
    plans["others"] = [text(both), text(joins.left_join(table, wide, [("id", "id")], broadcast_rows=0))]
    # The first pointers leave out the highest joins, and the first tour holds the numbers of its rows.
    large = [plans["round"][0], *plans["pointers"][1:], *plans["tour"][1:], *plans["others"]]
    assert len(large) > 5 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in large)
