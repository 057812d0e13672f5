"""Null policies of the aggregates: a missing input voids the result, or is passed over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("propagate", "skip")


def check_policy(nulls: str) -> None:
    if nulls not in POLICIES:
        raise ValueError(f"nulls must be one of {POLICIES}, not {nulls!r}")


def mean(column: str, nulls: str = "propagate") -> Column:
    check_policy(nulls)
    average = F.avg(F.col(column))
    if nulls == "skip":
        return average
    return F.when(F.count(F.col(column)) == F.count(F.lit(1)), average)


def correlation(a: str, b: str, nulls: str = "propagate") -> Column:
    """Pearson's r; NULL for a constant column."""
    check_policy(nulls)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    if nulls == "skip":
        return r
    return F.when(F.count_if(both) == F.count(F.lit(1)), r)


def complete_rows(df: DataFrame, columns: Sequence[str], invalid: str = "error") -> DataFrame:
    """Rows without a null or NaN in the columns; "error" fails the job on the first bad row."""
    if invalid not in ("error", "skip"):
        raise ValueError(f"invalid must be 'error' or 'skip', not {invalid!r}")
    if invalid == "skip":
        return df.dropna(subset=list(columns))
    checked = []
    for c in columns:
        value = F.col(c).cast("double")
        bad = value.isNull() | F.isnan(value)
        checked.append(F.when(bad, F.raise_error(F.lit(f"missing value in {c}"))).otherwise(value).alias(c))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, *checked)
