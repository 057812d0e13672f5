"""Consecutive numbers in a given order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import materialise


def number_in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add 1, 2, 3 ... in the given order.

    The range-partitioned sort fixes a position inside each partition; only the row counts,
    one per partition, are summed up on the driver.
    """
    spark = df.sparkSession
    placed = materialise(
        df.orderBy(*order).select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__pos"),
        ),
        "numbered",
    )
    offsets, before = [], 0
    for part, rows in sorted(map(tuple, placed.groupBy("__part").count().collect())):
        offsets.append((part, before))
        before += rows
    table = spark.createDataFrame(offsets, "__part int, __before long")
    return (
        placed.join(F.broadcast(table), "__part")  # one row per partition
        .withColumn(name, F.col("__before") + F.col("__pos") + 1)
        .drop("__part", "__pos", "__before")
    )
