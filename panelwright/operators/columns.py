"""Projection, renaming, casting and row filters, with names passed in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its exact name, which may hold dots, blanks and colons."""
    return F.col("`" + name.replace("`", "``") + "`")


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(n) for n in names])


def project_slice(df: DataFrame, first: int, last: int) -> DataFrame:
    """Columns by position, counted from 1, both ends included."""
    return project(df, df.columns[first - 1 : last])


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; a name that is not there is passed over."""
    gone = set(names)
    return project(df, [c for c in df.columns if c not in gone])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; a name that is not there is passed over."""
    return df.withColumnsRenamed(dict(names))


def parse_date(df: DataFrame, name: str, fmt: str = "yyyy-MM-dd", bad: str = "error") -> DataFrame:
    """Text to date; unreadable text fails the job, or becomes NULL with bad="null"."""
    if bad not in ("error", "null"):
        raise ValueError(f"bad must be 'error' or 'null', not {bad!r}")
    parsed = F.to_date(name, fmt) if bad == "error" else F.try_to_timestamp(name, F.lit(fmt)).cast("date")
    return df.withColumn(name, parsed)


def exclude(df: DataFrame, name: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is present and in none of the listed ones (a list, or a one-column table).

    A missing value is left out even if nothing is listed.
    """
    if isinstance(values, DataFrame):
        listed = values.select(values[values.columns[0]].alias(name)).distinct()
        return df.filter(F.col(name).isNotNull()).join(listed, name, "left_anti")
    present = F.col(name).isNotNull()
    return df.filter(present & ~F.col(name).isin(*values) if values else present)


def keep(df: DataFrame, name: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is one of the listed ones (a list, or a one-column table)."""
    if isinstance(values, DataFrame):
        listed = values.select(values[values.columns[0]].alias(name)).distinct()
        return df.join(listed, name, "left_semi")
    return df.filter(F.col(name).isin(*values))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or held by more than one row, with their row counts."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter((F.col("rows") > 1) | missing)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself, once its keys are known to be present and unique."""
    bad = repeated_keys(df, keys).take(1)
    if bad:
        raise ValueError(f"key {tuple(keys)} is missing or repeated, first case: {bad[0].asDict()}")
    return df
