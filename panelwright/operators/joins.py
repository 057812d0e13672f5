"""Left joins of a large table with its dimension tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.columns import quoted
from panelwright.session import scratch_path

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Dimension:
    """A table to attach: its rows, the key in the large table, and its own key (dropped after)."""

    table: DataFrame
    left_key: str
    right_key: str


def left_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[tuple[str, str]],
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    how: str = "left",
) -> DataFrame:
    """Join on pairs of (fact key, dimension key), keeping the fact's key columns.

    The dimension is computed once, stored, and measured on the way. Up to broadcast_rows and
    BROADCAST_BYTES it is broadcast, so the fact is not shuffled. Beyond that both sides are
    shuffled by key, and a key that holds a third of the fact is split over tasks by Spark's
    adaptive skew join, which divides a partition by the tasks that wrote it and so equal rows too.
    """
    keys = {r: f"__key{i}" for i, (_, r) in enumerate(on)}
    clash = (set(dim.columns) - set(keys)) & set(fact.columns)
    if clash:
        raise ValueError(f"columns on both sides of the join: {sorted(clash)}")
    right, small = _stored(dim.select(*[quoted(c).alias(keys.get(c, c)) for c in dim.columns]), broadcast_rows)
    condition = F.lit(True)
    for l, r in on:
        condition = condition & (quoted(l) == F.col(keys[r]))
    return fact.join(F.broadcast(right) if small else right.hint("merge"), condition, how).drop(*keys.values())


def sized(table: DataFrame, rows: float) -> DataFrame:
    """A side of a join, to be broadcast only if its counted rows are few, and merged otherwise.

    Left to itself, Spark goes by the bytes of compressed files and does not count what an explode
    adds, so that the driver may have to hold many times the bytes that were allowed.
    """
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def enrich(panel: DataFrame, dimensions: Sequence[Dimension], *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach dimension tables one after the other; a later one may use a column of an earlier one."""
    for d in dimensions:
        panel = left_join(panel, d.table, [(d.left_key, d.right_key)], broadcast_rows=broadcast_rows)
    return panel


def _stored(table: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """The stored table, and whether it is small by its rows and its bytes."""
    fixed = (T.NumericType, T.BooleanType, T.DatetimeType)
    wide = [f.name for f in table.schema.fields if not isinstance(f.dataType, fixed)]
    length = sum((F.coalesce(F.octet_length(quoted(c).cast("string")), F.lit(0)) for c in wide), F.lit(0))
    length = length + F.lit(8 * (len(table.columns) - len(wide)))
    seen, path = Observation(), scratch_path(table.sparkSession, "dimension")
    table.observe(
        seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length.cast("long")), F.lit(0)).alias("b")
    ).write.parquet(path)
    found = seen.get
    stored = table.sparkSession.read.schema(table.schema).parquet(path)
    return stored, found["n"] <= rows and found["b"] <= BROADCAST_BYTES
