"""Cluster labels on the feature table: attach, split, compare, relabel."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.columns import quoted
from panelwright.operators.joins import left_join
from panelwright.session import materialise

MOST_LABELS = 1000  # labels of one side that are assigned one to one


def attach_labels(df: DataFrame, labels: DataFrame, id_column: str, *, only_labelled: bool = False) -> DataFrame:
    """Join labels (one row per id); entities without one get NULL, or leave if only_labelled.

    The job fails on an id with several rows of labels, which would repeat the entity's rows.
    """
    names = [c for c in labels.columns if c != id_column]
    many = F.raise_error(F.concat(F.lit("several labels for "), F.col(id_column).cast("string")))
    single = labels.groupBy(quoted(id_column)).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(quoted(c)).alias(c) for c in names]
    )
    kinds = dict(labels.dtypes)
    checked = [F.when(F.col("__n") > 1, many.cast(kinds[c])).otherwise(quoted(c)).alias(c) for c in names]
    # Labels are as many as entities: merged by id, as Spark's estimate could have the driver broadcast them.
    joined = df.join(single.select(quoted(id_column), *checked).hint("merge"), id_column, "left")
    if not only_labelled:
        return joined
    return joined.dropna(how="all", subset=names)


def part(df: DataFrame, label_column: str, label) -> DataFrame:
    """The rows of one cluster."""
    return df.filter(quoted(label_column) == F.lit(label))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Number of rows per pair of labels."""
    return df.groupBy(quoted(a), quoted(b)).agg(F.count(F.lit(1)).alias("rows"))


def best_match(df: DataFrame, source: str, target: str) -> DataFrame:
    """Per label of source the target label it shares most rows with (the lower one on a tie)."""
    counts = crosstab(df.dropna(subset=[source, target]), source, target)
    best = counts.groupBy(quoted(source)).agg(
        F.min(F.struct((-F.col("rows")).alias("less"), quoted(target).alias("to"))).alias("best")
    )
    return best.select(
        quoted(source).alias("from"), F.col("best.to").alias("to"), (-F.col("best.less")).alias("rows")
    )


def assignment(df: DataFrame, source: str, target: str) -> DataFrame:
    """(from, to, rows): a label of target for each of source, no target label used twice.

    Of all such choices the one whose pairs share most rows in all; of several, the one that gives
    the lowest label to the lowest, and so on. Where source has more labels, those left over get
    NULL. Rows without one of the labels do not count; without any rows the result is empty.
    Only the crosstab meets in one task, at most MOST_LABELS labels a side, or the call fails.
    """
    counts = crosstab(df.dropna(subset=[source, target]), source, target)
    counts = materialise(counts.select(quoted(source).alias("from"), quoted(target).alias("to"), "rows"), "crosstab")
    wide = counts.agg(F.greatest(F.count_distinct("from"), F.count_distinct("to"))).first()[0]
    if wide > MOST_LABELS:
        raise ValueError(f"{wide} labels to assign, at most {MOST_LABELS}")

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        ones, others = sorted(table["from"].unique()), sorted(table["to"].unique())
        shared = np.zeros((max(len(ones), len(others)),) * 2, dtype=np.int64)
        shared[table["from"].map(ones.index), table["to"].map(others.index)] = table["rows"]
        chosen = assigned(shared)[: len(ones)]
        to = [others[j] if j < len(others) else None for j in chosen]
        return pd.DataFrame({"from": ones, "to": pd.Series(to, dtype=object), "rows": shared[range(len(ones)), chosen]})

    kinds = dict(counts.dtypes)
    return counts.groupBy().applyInPandas(solve, f"from {kinds['from']}, to {kinds['to']}, rows long")


def assigned(gain: np.ndarray) -> np.ndarray:
    """The column of each row, all different, of the greatest sum; of several the lowest, row by row.

    Shortest augmenting paths over reduced costs. The best choices are then the full matchings over
    the places whose reduced cost is zero, so lower columns are tried by swaps within these.
    """
    n = len(gain)
    cost = gain.max(initial=0) - gain
    at_row, at_column = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    owner = np.full(n, -1)
    for row in range(n):
        slack, came, done = cost[row] - at_row[row] - at_column, np.full(n, -1), np.zeros(n, dtype=bool)
        while True:
            column = int(np.flatnonzero(~done)[slack[~done].argmin()])
            done[column] = True
            if owner[column] < 0:
                break
            via = owner[column]
            reach = slack[column] + cost[via] - at_row[via] - at_column
            better = ~done & (reach < slack)
            slack[better], came[better] = reach[better], column
        moved = np.where(done, slack[column] - slack, 0)
        at_column -= moved
        held = np.flatnonzero(done & (owner >= 0))
        at_row[owner[held]] += moved[held]
        at_row[row] += slack[column]
        while column >= 0:
            owner[column] = owner[came[column]] if came[column] >= 0 else row
            column = came[column]
    tight = cost - at_row[:, None] - at_column == 0
    free = np.ones(n, dtype=bool)
    for row in range(n):
        old = int(np.flatnonzero(owner == row)[0])
        for column in np.flatnonzero(tight[row] & free):
            if column == old or _swapped(tight, owner, free, int(column), old, row):
                free[column] = False
                break
    return np.argsort(owner)


def _swapped(tight: np.ndarray, owner: np.ndarray, free: np.ndarray, column: int, old: int, row: int) -> bool:
    """Give a column to a row if the row that held it can move on, over others, to the old column."""
    unseen, came, queue = free.copy(), {}, [column]
    unseen[column] = False
    while queue and old not in came:
        here = queue.pop()
        for there in np.flatnonzero(tight[owner[here]] & unseen):
            unseen[there] = False
            came[int(there)] = here
            queue.append(int(there))
    if old not in came:
        return False
    while old != column:
        owner[old] = owner[came[old]]
        old = came[old]
    owner[column] = row
    return True


def relabel(df: DataFrame, column: str, mapping: Mapping | DataFrame) -> DataFrame:
    """Replace labels, all at once, by a dictionary or a table (from, to); others stay. Gives text."""
    text = quoted(column).cast("string")
    if isinstance(mapping, DataFrame):
        table = mapping.select(
            F.col("from").cast("string").alias("__from"), F.col("to").cast("string").alias("__to")
        )
        joined = left_join(df.withColumn("__label", text), table, [("__label", "__from")])
        new = F.coalesce(F.col("__to"), F.col("__label"))
        return joined.withColumn(column, new).select(*[quoted(c) for c in df.columns])
    new = None
    for old, to in mapping.items():
        hit = text == F.lit(str(old))
        new = F.when(hit, F.lit(str(to))) if new is None else new.when(hit, F.lit(str(to)))
    return df.withColumn(column, text if new is None else new.otherwise(text))
