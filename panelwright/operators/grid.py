"""Grid cells and boxes for neighbour searches by equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells are indexed on this many leading dimensions; points within a radius differ by at most the
# radius in every one of them, so fewer dimensions only mean more candidates.
GRID_DIMENSIONS = 3


def selective(rows: DataFrame, columns: Sequence[str], width: float) -> list[str]:
    """The columns in the order of how well cells of a width part the rows, the best first.

    Measured by the sum of squared cell counts of each column: one aggregate, counted map-side.
    """
    if len(columns) <= GRID_DIMENSIONS or width <= 0:
        return list(columns)
    cells = [F.struct(F.lit(i).alias("i"), F.floor(F.col(c) / F.lit(width)).alias("cell")) for i, c in enumerate(columns)]
    counts = rows.select(F.inline(F.array(*cells))).groupBy("i", "cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowds = {r["i"]: r["s"] for r in counts.groupBy("i").agg(F.sum(F.col("n") * F.col("n")).alias("s")).collect()}
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (crowds.get(i, 0.0), i))]


def squared(values: Sequence[Column]) -> Column:
    parts = [v * v for v in values]
    return sum(parts[1:], parts[0])


def around(df: DataFrame, coordinates: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Repeat each row for its cell and all adjacent ones, 3 per dimension."""
    for value, name in zip(coordinates, names):
        df = df.withColumn(name, F.explode(F.sequence(value - 1, value + 1)))
    return df


def least_gap(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared smallest distance between two boxes given by the lists of their bounds."""
    zero = F.lit(0.0)
    return squared([F.greatest(lb - ha, la - hb, zero) for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b)])


def largest_gap(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared largest distance between points of two boxes."""
    return squared([F.greatest(hb - la, ha - lb) for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b)])
