"""Buckets, day counters and durations between thresholds of a cumulative metric."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.running import running_sums

AsOf = str | datetime.date | Column


def bucket_name(threshold) -> str:
    return f"bucket_{threshold}"


def counter_name(threshold) -> str:
    return f"day_{threshold}"


def duration_name(lower, upper) -> str:
    return f"days_{lower}_to_{upper}"


def threshold_counters(
    panel: DataFrame,
    entity: str,
    time: str,
    metric: str,
    thresholds: Sequence[int],
    *,
    buckets: bool = True,
    block: Column | None = None,
) -> DataFrame:
    """Per threshold T a bucket ("<T", ">=T") and the running number of rows at or above T.

    The counter is 0 below T, 1 on the first row at or above T in time order, and counts rows,
    not calendar days. A null metric gives a null bucket and a null counter. All thresholds
    share one shuffle and one sort: the row number inside the upper bucket equals the running
    count of rows at or above T.
    """
    value = F.col(metric)
    counted = running_sums(
        panel,
        [entity],
        time,
        {f"__n_{t}": F.when(value >= F.lit(t), 1).otherwise(0) for t in thresholds},
        block=block,
    )
    added = []
    for t in thresholds:
        if buckets:
            added.append(
                F.when(value < F.lit(t), F.lit(f"<{t}"))
                .when(value >= F.lit(t), F.lit(f">={t}"))
                .alias(bucket_name(t))
            )
        added.append(
            F.when(value < F.lit(t), F.lit(0))
            .when(value >= F.lit(t), F.col(f"__n_{t}"))
            .cast("int")
            .alias(counter_name(t))
        )
    return counted.select(*panel.columns, *added)


def first_crossing(running: DataFrame, threshold) -> DataFrame:
    """The row of each entity on which it first reaches the threshold."""
    return running.filter(F.col(counter_name(threshold)) == 1)


def latest(table: DataFrame, time: str) -> Column:
    """The last date of a table as a scalar subquery. Ask the raw table: that is a scan of one column."""
    return table.agg(F.max(time)).scalar()


def resolve_as_of(table: DataFrame, time: str, as_of: AsOf) -> Column:
    """A date as a column: a column as it is, "max" for the last date of the table, or a date."""
    if isinstance(as_of, Column):
        return as_of
    if as_of == "max":
        return latest(table, time)
    return F.lit(as_of).cast(table.schema[time].dataType)


def durations(
    running: DataFrame,
    entity: str,
    thresholds: Sequence[int],
    *,
    time: str | None = None,
    as_of: AsOf | None = None,
) -> DataFrame:
    """One row per entity: for each pair A < B the counter of A on the row where B is first reached.

    NULL where B is never reached. With time and as_of, rows after as_of are not looked at;
    by default a crossing after the date of interest counts too.
    """
    if as_of is not None:
        running = running.filter(F.col(time) <= resolve_as_of(running, time, as_of))
    pairs = combinations(sorted(thresholds), 2)
    return running.groupBy(entity).agg(
        *[
            F.max(F.when(F.col(counter_name(b)) == 1, F.col(counter_name(a)))).alias(duration_name(a, b))
            for a, b in pairs
        ]
    )


def cross_section(
    running: DataFrame,
    time: str,
    as_of: AsOf,
    *,
    reached=None,
) -> DataFrame:
    """The rows of one date ("max", latest(...) or a given one), if asked only of entities past a threshold."""
    rows = running.filter(F.col(time) == resolve_as_of(running, time, as_of))
    return rows if reached is None else rows.filter(F.col(counter_name(reached)) != 0)


def day_n_section(running: DataFrame, threshold, day: int, metric: str, above) -> DataFrame:
    """The day-th row of each entity after a threshold, where the metric exceeds a bound."""
    return running.filter((F.col(counter_name(threshold)) == day) & (F.col(metric) > F.lit(above)))


def significant(section: DataFrame, metric: str, at_least) -> DataFrame:
    return section.filter(F.col(metric) >= F.lit(at_least))


def with_durations(section: DataFrame, spans: DataFrame, entity: str) -> DataFrame:
    """Attach the durations to a cross-section; both hold at most one row per entity."""
    return section.join(spans, entity, "left")


def label_sections(sections: dict[str, DataFrame], name: str = "section") -> DataFrame:
    """Stack cross-sections of equal columns under a label."""
    stacked = None
    for label, section in sections.items():
        part = section.withColumn(name, F.lit(label))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked
