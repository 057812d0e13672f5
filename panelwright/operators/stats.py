"""Profiles, summaries, correlations and standardised columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.nulls import correlation, mean
from panelwright.operators.columns import quoted
from panelwright.operators.quantiles import exact_quantiles


def profile(df: DataFrame, by: str, columns: Sequence[str], *, nulls: str = "propagate") -> DataFrame:
    """Row count and means of all columns per group, in one pass."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), *[mean(c, nulls).alias(f"mean_{c}") for c in columns]
    )


def table_summary(df: DataFrame, columns: Sequence[str] | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and group): type, row and null counts, and for numbers and dates' day
    numbers minimum, quartiles, mean and maximum."""
    by = list(by)
    columns = [c for c in (columns or df.columns) if c not in by]
    kinds = {c: df.schema[c].dataType for c in columns}
    numeric = [c for c in columns if isinstance(kinds[c], (T.NumericType, T.DatetimeType))]
    numbers = {c: _number(quoted(c), kinds[c]) for c in numeric}
    facts = []
    for c in columns:
        x = quoted(c)
        number = numbers.get(c, F.lit(None).cast("double"))
        facts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c].simpleString()).alias("type"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(x.isNull()).alias("nulls"),
                F.min(number).alias("min"),
                F.avg(number).alias("mean"),
                F.max(number).alias("max"),
            )
        )
    keys = [quoted(b) for b in by]
    one_pass = df.groupBy(*keys).agg(F.array(*facts).alias("facts"))
    facts_long = one_pass.select(*keys, F.inline("facts"))
    if not numeric:
        empty = F.lit(None).cast("double")
        return facts_long.withColumns({"q1": empty, "median": empty, "q3": empty})
    quartiles = exact_quantiles(df.select(*keys, *[v.alias(c) for c, v in numbers.items()]), by, numeric)
    right = quartiles.select(
        *[quoted(b).alias(f"__by{i}") for i, b in enumerate(by)],
        F.col("column").alias("__column"),
        F.col("quantiles"),
    )
    on = F.col("column") == F.col("__column")
    for i, b in enumerate(by):
        on = on & quoted(b).eqNullSafe(F.col(f"__by{i}"))
    return facts_long.join(right, on, "left").select(
        *keys,
        "column",
        "type",
        "rows",
        "nulls",
        "min",
        F.get("quantiles", F.lit(0)).alias("q1"),
        F.get("quantiles", F.lit(1)).alias("median"),
        "mean",
        F.get("quantiles", F.lit(2)).alias("q3"),
        "max",
    )


def _number(x: Column, kind: T.DataType) -> Column:
    """A column as a double; dates and times as days since 1970, times with their fraction of a day."""
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(kind, T.DatetimeType):
        return F.unix_micros(x.cast("timestamp")) / F.lit(86_400_000_000.0)
    return x.cast("double")


def corr_matrix(df: DataFrame, columns: Sequence[str], *, nulls: str = "propagate") -> DataFrame:
    """Pearson correlations of all pairs in long form (a, b, r), both triangles and the diagonal."""
    names = {c: f"__c{i}" for i, c in enumerate(columns)}
    numbers = df.select(*[quoted(c).cast("double").alias(n) for c, n in names.items()])
    pairs = list(combinations(columns, 2))
    rs = [correlation(names[a], names[b], nulls) for a, b in pairs]
    present = [
        F.when((F.count(n) == F.count(F.lit(1))) if nulls == "propagate" else (F.count(n) > 0), 1.0)
        for n in names.values()
    ]
    cells = []
    measured = numbers.agg(F.array(*rs, *present).alias("r"))
    for i, (a, b) in enumerate(pairs):
        r = F.get("r", F.lit(i)).alias("r")
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r))
        cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r))
    for i, c in enumerate(columns):
        r = F.get("r", F.lit(len(pairs) + i)).alias("r")
        cells.append(F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), r))
    return measured.select(F.inline(F.array(*cells)))


def corr_prune(matrix: DataFrame, limit: float) -> DataFrame:
    """Which columns to keep: of each pair with |r| over the limit the one with the larger mean |r| goes.

    Takes the table of corr_matrix; returns (column, mean_abs_r, keep). On a tie the later name goes.
    """
    off = matrix.filter(F.col("a") != F.col("b"))
    means = off.groupBy("a").agg(F.round(F.avg(F.abs("r")), 9).alias("m"))
    rival = means.select(F.col("a").alias("b"), F.col("m").alias("m_b"))
    judged = off.join(means, "a").join(rival, "b")
    loses = (F.abs("r") > F.lit(limit)) & (
        (F.col("m") > F.col("m_b")) | ((F.col("m") == F.col("m_b")) & (F.col("a") > F.col("b")))
    )
    return judged.groupBy(F.col("a").alias("column")).agg(
        F.first("m").alias("mean_abs_r"), (~F.coalesce(F.bool_or(loses), F.lit(False))).alias("keep")
    )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean, over its sample deviation; NULL for a constant column.

    The means and deviations are one aggregate with map-side sums, read as a scalar subquery.
    """
    facts = df.agg(F.array(*[f(quoted(c)).cast("double") for c in columns for f in (F.avg, F.stddev_samp)]).alias("f"))
    stats = facts.scalar()
    scaled = {}
    for i, c in enumerate(columns):
        m, s = F.get(stats, F.lit(2 * i)), F.get(stats, F.lit(2 * i + 1))
        scaled[c] = F.when(s > 0, (quoted(c) - m) / s).alias(c)
    return df.select(*[scaled.get(c, quoted(c)) for c in df.columns])
