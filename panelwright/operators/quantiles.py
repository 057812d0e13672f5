"""Exact quantiles of large groups without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators.columns import quoted
from panelwright.operators.joins import left_join
from panelwright.session import materialise

QUARTILES = (0.25, 0.5, 0.75)
MARGIN = 0.01
ACCURACY = 1_000


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float] = QUARTILES,
) -> DataFrame:
    """Quantiles by linear interpolation between order statistics, nulls passed over.

    Returns one row per group and column: by..., column, quantiles (an array in the order of
    the probabilities). Three scans, none of which shuffles the raw rows:

    1. a mergeable sketch per group gives cut points a little below and above each quantile;
    2. the rows between cut points are counted, which tells in which slices the wanted ranks lie;
    3. only the rows of those slices, counted per value before the shuffle, are sorted.

    The sketch decides how many rows step 3 keeps, never the result.
    """
    by = list(by)
    names = {c: f"__v{i}" for i, c in enumerate(columns)}
    keys = [f"__k{i}" for i in range(len(by))]
    wide = df.select(
        *[quoted(b).alias(k) for b, k in zip(by, keys)],
        *[quoted(c).cast("double").alias(n) for c, n in names.items()],
    )
    long = wide.unpivot(keys, list(names.values()), "__column", "__value").filter(F.col("__value").isNotNull())
    for k in keys:
        # A null key forms a group of its own, and must meet itself in the joins below.
        long = long.withColumn(k, F.struct(F.col(k).alias("key"), F.col(k).isNull().alias("missing")))
    group = [*keys, "__column"]

    cuts = sorted({round(min(max(p + s * MARGIN, 0.0), 1.0), 6) for p in probabilities for s in (-1, 1)})
    bounds = materialise(
        long.groupBy(*group).agg(
            F.percentile_approx("__value", F.array(*map(F.lit, cuts)), ACCURACY).alias("__cuts"),
            F.count(F.lit(1)).alias("__n"),
        ),
        "quantile-cuts",
    )
    slice_of = sum(
        (F.when(F.col("__value") > F.get("__cuts", F.lit(i)), 1).otherwise(0) for i in range(len(cuts))), F.lit(0)
    )
    on = [(k, k) for k in group]
    sliced = left_join(long, bounds, on, how="inner").withColumn("__slice", slice_of)

    # At most len(cuts) + 1 slices per group, so this window is over a handful of rows.
    earlier = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*group, "__slice", "__n").agg(F.count(F.lit(1)).alias("__rows"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    ranks = [r for p in probabilities for r in _ranks(p)]
    holds = F.lit(False)
    for r in ranks:
        holds = holds | ((F.col("__before") <= r) & (r < F.col("__before") + F.col("__rows")))
    wanted = materialise(counts.filter(holds).select(*group, "__slice", "__before"), "quantile-slices")

    values = (
        left_join(sliced, wanted, [*on, ("__slice", "__slice")], how="inner")
        .groupBy(*group, "__slice", "__before", "__n", "__value")
        .agg(F.count(F.lit(1)).alias("__rows"))
    )
    upto = Window.partitionBy(*group, "__slice").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("__last", F.col("__before") + F.sum("__rows").over(upto))
    found = ranked.groupBy(*group).agg(
        F.first("__n").alias("__n"),
        *[
            F.max(
                F.when((F.col("__last") - F.col("__rows") <= r) & (r < F.col("__last")), F.col("__value"))
            ).alias(f"__q{i}")
            for i, r in enumerate(ranks)
        ],
    )
    quantiles = []
    for i, p in enumerate(probabilities):
        position = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        quantiles.append(low + (high - low) * (position - F.floor(position)))
    back = F.create_map(*[F.lit(x) for c, n in names.items() for x in (n, c)])
    return found.select(
        *[F.col(k)["key"].alias(b) for b, k in zip(by, keys)],
        back[F.col("__column")].alias("column"),
        F.array(*quantiles).alias("quantiles"),
    )


def _ranks(p: float):
    position = (F.col("__n") - 1) * F.lit(float(p))
    return F.floor(position), F.ceil(position)
