"""Running sums along time inside each entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql import functions as F

BLOCK_SECONDS = 3600


def running_sums(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    sums: Mapping[str, Column],
    *,
    block: Column | None = None,
) -> DataFrame:
    """Add, per entity, the sums of all rows up to and including each one in time order.

    (entity, time) must be unique; a repeated pair fails the job, found in the same window.

    When time is a date an entity therefore has at most one row a day, which bounds every
    window, and one shuffle by entity is enough. When it is a timestamp nothing bounds an
    entity, so its rows are cut into blocks of time: the blocks are summed inside themselves in
    parallel, the block totals (pre-aggregated before the shuffle) are summed up per entity,
    and each row gets the total of the earlier blocks.
    """
    entity = list(entity)
    if block is None and not isinstance(df.schema[time].dataType, T.DateType):
        block = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(BLOCK_SECONDS * 1_000_000))
    if block is None:
        window = Window.partitionBy(*entity).orderBy(time)
        return _summed(df, window, time, sums)

    blocked = df.withColumn("__block", block)
    window = Window.partitionBy(*entity, "__block").orderBy(time)
    inside = _summed(blocked, window, time, sums)
    totals = blocked.groupBy(*entity, "__block").agg(*[F.sum(v).alias(f"__sum_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*entity).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(e).alias(f"__on_{i}") for i, e in enumerate(entity)],
        F.col("__block").alias("__on_block"),
        *[F.sum(f"__sum_{n}").over(earlier).alias(f"__before_{n}") for n in sums],
    )
    on = F.col("__block").eqNullSafe(F.col("__on_block"))
    for i, e in enumerate(entity):
        on = on & F.col(e).eqNullSafe(F.col(f"__on_{i}"))
    joined = inside.join(offsets, on, "left")
    for n in sums:
        before, here = F.col(f"__before_{n}"), F.col(n)
        joined = joined.withColumn(
            n, F.when(before.isNull(), here).otherwise(before + F.coalesce(here, F.lit(0)))
        )
    return joined.select(*df.columns, *sums)


def _summed(df: DataFrame, window, time: str, sums: Mapping[str, Column]) -> DataFrame:
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    error = F.raise_error(F.lit("two rows of one entity at the same time")).cast("boolean")
    summed = df.select(
        "*",
        (F.row_number().over(window) != F.rank().over(window)).alias("__repeated"),
        *[F.sum(v).over(frame).alias(n) for n, v in sums.items()],
    )
    # As a filter the check is part of every plan, whichever columns are read later.
    return summed.filter(F.when(F.col("__repeated"), error).otherwise(F.lit(True))).drop("__repeated")
