"""Ward's agglomeration on Euclidean points, in rounds of mutual nearest neighbours.

The height of joining two clusters is sqrt(2 s t / (s + t)) times the distance of their centres,
so a cluster is (smallest member, size, centre) and no distance matrix is kept. Ward's distance
is reducible: all pairs that are each other's nearest can be joined in one round, and the tree is
the one that joining the closest pair at a time gives. The height is never below sqrt(min(s, t))
times the distance of the centres, so a cluster of at least 2^i members finds every partner of its
size or larger, up to height h, within h / 2^(i/2): clusters are put into classes by size, and each
class searches a grid of its own width. h is chosen so that the candidates stay near a budget; once
all pairs of clusters fit the budget, they are compared without a grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.nulls import complete_rows
from panelwright.functions.numbering import number_in_order
from panelwright.operators.columns import quoted
from panelwright.operators.grid import GRID_DIMENSIONS, selective
from panelwright.operators import joins
from panelwright.operators.joins import left_join, sized
from panelwright.session import materialise, materialise_counted, scratch_path, spread, write_counted

CANDIDATES = 4_000_000
CANDIDATES_PER_CLUSTER = 64
# Half of a cell's 27 neighbours, itself among them.
NEIGHBOURS = 14
PAIRS_PER_TASK = 250_000
# What a cut or an elbow may ask for: so many rows are broadcast and reach the driver.
MOST_CLUSTERS = 10_000


def ward_tree(
    df: DataFrame,
    id_column: str,
    features: Sequence[str],
    *,
    invalid: str = "error",
    candidates: int = CANDIDATES,
) -> DataFrame:
    """All n - 1 joins: (left, right, height, size, round).

    A cluster goes by its smallest member: `right` is taken into `left`, which is smaller. Each
    member but the first thus occurs once as `right`. Copies of a point are joined to the first
    of them at height 0, with the size of the whole group of copies.
    """
    d = len(features)
    xs = [f"x{i}" for i in range(d)]
    rows = df.select(quoted(id_column).alias("id"), *[quoted(f).cast("double").alias(x) for f, x in zip(features, xs)])
    rows = materialise(complete_rows(rows, xs, invalid), "points")
    live = rows.groupBy(*xs).agg(F.min("id").alias("rep"), F.count(F.lit(1)).cast("double").alias("size"))
    live = materialise(live.select("rep", "size", *xs), "clusters")

    firsts = live.filter("size > 1").select("rep", "size", *[F.col(x).alias(f"{x}_key") for x in xs])
    copies = left_join(rows, firsts, [(x, f"{x}_key") for x in xs], how="inner").filter("id != rep")
    copies = copies.selectExpr("rep AS left", "id AS right", "0D AS height", "cast(size AS long) AS size", "0 AS round")

    corners = live.agg(F.count(F.lit(1)), F.sum("size"), *[f(x) for x in xs for f in (F.min, F.max)]).first()
    m, points = corners[0], corners[1] or 1.0
    extent = math.sqrt(sum((corners[3 + 2 * i] - corners[2 + 2 * i]) ** 2 for i in range(d))) if m else 0.0
    highest = extent * math.sqrt(points)  # no join is higher
    radius = highest
    number = 0
    if m * m > candidates:
        radius = extent / m ** (1 / d)
        order = selective(live, xs, radius)
        live = live.select("rep", "size", *[F.col(x).alias(n) for x, n in zip(order, xs)])
        radius = _widest(live, xs, radius, highest, m, candidates)
    # The state after each round is one part of a table; its joined clusters are the tree.
    states = scratch_path(df.sparkSession, "clusters")
    while m > 1:
        number += 1
        everything = m * m <= candidates
        pairs = min(m * m / 2, NEIGHBOURS * max(candidates, CANDIDATES_PER_CLUSTER * m))
        # A cluster is listed once for each class up to its own: at most so often in all.
        searched = F.broadcast(live) if everything else sized(live, m * (1 + math.log2(points / m)))
        step = _round(spread(live, pairs, PAIRS_PER_TASK), searched, xs, radius, everything)
        joined, left = write_counted(step, f"{states}/round={number}")
        live = joined.select("rep", "size", *xs)
        before, m = m, left
        if everything or m * m <= candidates:
            continue
        if m == before:
            radius *= 2
        elif before - m < before / 10:
            radius = _widest(live, xs, radius, highest, m, candidates, shrink=False)
    if not number:
        return copies
    whole = df.sparkSession.read.schema(T.StructType([*joined.schema.fields, T.StructField("round", T.IntegerType())]))
    merges = whole.parquet(states).filter("right is not null")
    merges = merges.selectExpr("rep AS left", "right", "height", "cast(size AS long) AS size", "round")
    return copies.unionByName(merges)


SIZE_CLASS = "cast(floor(log2(size)) AS int)"


def cells(xs: Sequence[str], radius: float) -> list[str]:
    """Grid coordinates of a cluster in the grid of class k, as SQL."""
    return [f"cast(floor({x} * pow(2D, k / 2D) / {radius!r}D) AS long)" for x in xs[:GRID_DIMENSIONS]]


def crowd(live: DataFrame, xs: Sequence[str], radius: float) -> tuple[float, float]:
    """Candidates of all cells together, and of the fullest cell: searchers times those found there."""
    listed = live.withColumn("own", F.expr(SIZE_CLASS)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("own"))))
    keys = ["k", *[F.expr(c).alias(f"c{i}") for i, c in enumerate(cells(xs, radius))]]
    counts = listed.groupBy(*keys).agg(F.count_if(F.col("own") == F.col("k")).alias("a"), F.count(F.lit(1)).alias("b"))
    n = F.col("a").cast("double") * F.col("b")
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    return total or 0.0, most or 0.0


def _widest(live, xs, radius, highest, m, candidates, shrink=True) -> float:
    """Double or halve a radius to the widest whose cells are not crowded.

    No cell may hold more candidates than one task should compare, nor all cells together more
    than the budget.
    """
    extent = highest

    def crowded(r):
        total, most = crowd(live, xs, r)
        return total > max(candidates, CANDIDATES_PER_CLUSTER * m) or most > candidates

    if shrink and crowded(radius):
        while radius > extent * 1e-12:
            radius /= 2
            if not crowded(radius):
                break
        return radius
    while radius <= extent and not crowded(radius * 2):
        radius *= 2
    return radius


def _round(probes: DataFrame, live: DataFrame, xs: Sequence[str], radius: float, everything: bool) -> DataFrame:
    """Join all mutual nearest pairs of height up to the radius; joined clusters carry right and height.

    With `everything` all pairs are compared, whatever their height.

    `probes` is the same table as `live`, divided by the work of comparing its rows; a hint on `live`
    says how the two are joined, and gets lost in a named subquery. A pair takes
    both clusters along, so that it can become the joined one, and every cluster also offers
    itself as the last resort: grouping the choices by pair then yields the next state. Equal
    heights are ordered by a hash of the pair, so that chains of ties break up in few rounds.
    Clusters of one class find each other, so that each takes only offers of its own search, of which
    a task keeps the best; a pair of two classes, met once, is offered to both.
    """
    own = cells(xs, radius)
    g = range(len(own))
    adjacent = " ".join(f"LATERAL VIEW explode(sequence({c} - 1, {c} + 1)) t{i} AS c{i}" for i, c in zip(g, own))
    listed = "LATERAL VIEW explode(sequence(0, class)) t AS k"
    at = ", ".join(f"{c} AS c{i}" for i, c in zip(g, own))
    same = " AND ".join(["a.k = b.k", *[f"a.c{i} = b.c{i}" for i in g]])
    if everything:
        adjacent, listed, at, same = "", "LATERAL VIEW explode(array(0)) t AS k", "0 AS c0", "a.k = b.k"
    classed = "0" if everything else SIZE_CLASS
    b = f"(SELECT *, {at} FROM (SELECT *, {classed} AS class FROM {{live}}) {listed})"
    gap = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    mine, theirs = (f"struct({', '.join(f'{t}.{c}' for c in ('rep', 'size', *xs))})" for t in "ab")
    one, other = f"if(a.rep < b.rep, {mine}, {theirs})", f"if(a.rep < b.rep, {theirs}, {mine})"
    centre = ", ".join(
        f"CASE WHEN ends = 2 THEN (one.{x} * one.size + other.{x} * other.size) / (one.size + other.size) "
        f"ELSE self.{x} END AS {x}"
        for x in xs
    )
    return live.sparkSession.sql(
        f"""
        WITH searching AS (SELECT *, {classed} AS k FROM {{probes}}),
        a AS (SELECT * FROM searching {adjacent}),
        pairs AS (
          SELECT 2 * a.size * b.size / (a.size + b.size) * ({gap}) AS h2,
                 xxhash64(least(a.rep, b.rep), greatest(a.rep, b.rep)) AS tie, {one} AS one, {other} AS other,
                 if(b.class > a.k, array(a.rep, b.rep), array(a.rep)) AS reps
          FROM a JOIN {b} AS b ON {same} WHERE a.rep <> b.rep),
        offers AS (
          SELECT explode(reps) AS rep, struct(h2, tie, one, other) AS pair
          FROM pairs WHERE {'true' if everything else f'h2 <= {radius * radius!r}D'}
          UNION ALL
          SELECT a.rep, struct(double('infinity'), 0L, {mine}, if(false, {mine}, NULL)) FROM {{probes}} AS a),
        chosen AS (SELECT rep, min(pair) AS pair FROM offers GROUP BY rep),
        grouped AS (
          SELECT first(pair.one) AS one, first(pair.other) AS other, first(pair.h2) AS h2, count(*) AS ends,
                 first(CASE WHEN rep = pair.one.rep THEN pair.one ELSE pair.other END) AS self
          FROM chosen GROUP BY pair.one.rep, pair.other.rep)
        SELECT CASE WHEN ends = 2 THEN one.rep ELSE self.rep END AS rep,
               CASE WHEN ends = 2 THEN one.size + other.size ELSE self.size END AS size, {centre},
               CASE WHEN ends = 2 THEN other.rep END AS right, CASE WHEN ends = 2 THEN sqrt(h2) END AS height
        FROM grouped
        """,
        probes=probes,
        live=live,
    )


def _order(descending: bool) -> list:
    keys = ("height", "round", "right")
    return [F.col(k).desc() if descending else F.col(k).asc() for k in keys]


def numbered(tree: DataFrame) -> DataFrame:
    """The joins in order of height, numbered by `step` from 1 to n - 1."""
    return number_in_order(tree, _order(False), "step")


def merge_matrix(df: DataFrame, id_column: str, tree: DataFrame) -> DataFrame:
    """(step, first, second, height, size): what each join of the numbered tree brings together.

    A negative number is a single row, counted from 1 in the order of its id; a positive one is the
    step that made the cluster. Single rows come before clusters, smaller before larger rows and
    earlier before later steps. `df` holds the ids the tree was built on; ids must be unique.
    """
    row = number_in_order(df.select(quoted(id_column).alias("id")), [F.col("id")], "row")
    steps, n = materialise_counted(numbered(tree).select("step", "left", "right", "height", "size"), "steps")
    # A cluster goes by its smallest member, so that the one with the smallest of all can be joined n - 1
    # times: the join before is the neighbour in a numbered order and not in a window by member.
    ordered = number_in_order(steps.select("left", "step"), [F.col("left"), F.col("step")], "at")
    ordered = materialise(ordered, "joins-by-member")
    before = ordered.select((F.col("at") + 1).alias("at"), F.col("left").alias("member"), F.col("step").alias("made"))
    earlier = ordered.join(sized(before, n), "at").filter("left = member").select("step", "made")
    last = steps.groupBy(F.col("left").alias("right")).agg(F.max("step").alias("grown"))
    single = row.select(F.col("id").alias("left"), F.col("row").alias("left_row"))
    other = row.select(F.col("id").alias("right"), F.col("row").alias("right_row"))
    joined = steps.join(sized(earlier, n), "step", "left").join(sized(last, n), "right", "left")
    joined = joined.join(sized(single, n), "left").join(sized(other, n), "right")
    a, b = F.coalesce("made", -F.col("left_row")), F.coalesce("grown", -F.col("right_row"))
    rows = (a < 0) & (b < 0)  # `left` has the smaller id
    first, second = F.when(rows, a).otherwise(F.least(a, b)), F.when(rows, b).otherwise(F.greatest(a, b))
    return joined.select("step", first.alias("first"), second.alias("second"), "height", "size")


def leaf_order(df: DataFrame, id_column: str, tree: DataFrame) -> DataFrame:
    """(id, place): the places from 1 of the rows when the tree is drawn without crossings.

    The first cluster of each join (see merge_matrix) stands before the second. The tour around the
    tree, which enters and leaves each cluster, is a list: the rows from a place to its end are
    counted by pointer jumping, where every element is the target of one other at most, however
    deep or lopsided the tree is. Rounds grow with the logarithm of the number of rows.
    """
    spark = df.sparkSession
    row = number_in_order(df.select(quoted(id_column).alias("id")), [F.col("id")], "row")
    matrix = materialise(merge_matrix(df, id_column, tree), "merge-matrix")
    # Elements: row r is -r, entering the cluster of step s is 2 s and leaving it 2 s + 1.
    first, second = (F.when(F.col(c) < 0, F.col(c)).otherwise(2 * F.col(c)) for c in ("first", "second"))
    left, right = (F.when(F.col(c) < 0, F.col(c)).otherwise(2 * F.col(c) + 1) for c in ("first", "second"))
    hops = [(2 * F.col("step"), first), (left, second), (right, 2 * F.col("step") + 1)]
    pairs = F.explode(F.array(*[F.struct(at.alias("at"), next_.alias("next")) for at, next_ in hops]))
    tour = matrix.select(pairs.alias("p")).selectExpr("p.at AS at", "p.next AS next", "if(p.at < 0, 1L, 0L) AS rows")
    tour, going = materialise_counted(tour, "tour")
    n = row.agg(F.count(F.lit(1))).first()[0]
    hint = "BROADCAST" if 3 * n <= joins.BROADCAST_ROWS else "MERGE"  # a row more and two hops a join
    while going:
        step = spark.sql(
            f"""
            SELECT /*+ {hint}(q) */ p.at, q.next, p.rows + coalesce(q.rows, 0L) AS rows
            FROM {{tour}} p LEFT JOIN {{tour}} q ON p.next = q.at WHERE p.next IS NOT NULL
            UNION ALL SELECT at, next, rows FROM {{tour}} WHERE next IS NULL
            """,
            tour=tour,
        )
        tour, going = materialise_counted(step, "tour", F.col("next").isNotNull())
    leaves = tour.filter("at < 0").select((-F.col("at")).alias("row"), (F.lit(n + 1) - F.col("rows")).alias("place"))
    # A table of one row has no join.
    placed = row.join(sized(leaves, n), "row", "left").withColumn("place", F.coalesce("place", F.lit(1).cast("long")))
    return placed.select(F.col("id").alias(id_column), "place")


def cut(df: DataFrame, id_column: str, tree: DataFrame, k: int) -> DataFrame:
    """(id, cluster): k clusters, numbered by their smallest member.

    The k - 1 highest joins are left out. Following the rest from `right` to `left` leads to the
    smallest member; each round triples the distance followed.
    """
    if not 1 <= k <= MOST_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MOST_CLUSTERS}")
    kept = tree
    if k > 1:
        highest = tree.orderBy(*_order(True)).limit(k - 1).select("right")
        kept = tree.join(F.broadcast(highest), "right", "left_anti")  # k - 1 rows
    pointers, n = materialise_counted(kept.select(F.col("right").alias("node"), F.col("left").alias("at")), "pointers")
    hint = "BROADCAST" if n <= joins.BROADCAST_ROWS else "MERGE"
    further = 1
    while further:
        step = df.sparkSession.sql(
            f"""
            SELECT /*+ {hint}(q, r) */ p.node, coalesce(r.at, q.at, p.at) AS at, r.at IS NOT NULL AS further
            FROM {{pointers}} p LEFT JOIN {{pointers}} q ON p.at = q.node LEFT JOIN {{pointers}} r ON q.at = r.node
            """,
            pointers=pointers,
        )
        pointers, further = materialise_counted(step, "pointers", F.col("further"))
        pointers = pointers.select("node", "at")
    ids = df.select(quoted(id_column).alias("node"))
    rooted = ids.join(sized(pointers, n), "node", "left").withColumn("root", F.coalesce("at", "node"))
    roots = sorted(r["root"] for r in rooted.select("root").distinct().collect())  # k values
    label = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root")).cast("int")
    return rooted.select(F.col("node").alias(id_column), label.alias("cluster"))


def elbow(tree: DataFrame, ks: Sequence[int] = range(1, 11)) -> DataFrame:
    """Total within-cluster sum of squares per k, for the data the tree was built on.

    A join of height h adds h * h / 2, so k clusters lack the k - 1 largest of these.
    """
    ks = sorted(ks)
    if ks and not 1 <= ks[0] <= ks[-1] <= MOST_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MOST_CLUSTERS}")
    total = tree.agg(F.sum(F.col("height") * F.col("height") / 2)).first()[0] or 0.0
    top = [r["height"] for r in tree.orderBy(F.desc("height")).limit(ks[-1] - 1).select("height").collect()]
    rows = [(k, max(total - math.fsum(h * h / 2 for h in top[: k - 1]), 0.0)) for k in ks]
    return tree.sparkSession.createDataFrame(rows, "k int, wss double")
