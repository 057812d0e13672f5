"""Files in the shared folder, offsets of ordered rows, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
import posixpath
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import scratch_path

MEMBER_BYTES = 64 << 20  # a written file is closed once it holds so many bytes


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder, with the scheme spelled out, that tasks open through Arrow's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and full[6] != "/" else full


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def attempt_name() -> str:
    """A file name that no other task and no other attempt of this task uses."""
    context = TaskContext.get()
    return f"{context.stageId()}-{context.partitionId():06d}-{context.taskAttemptId()}"


def join_path(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def release() -> None:
    """Give free memory back to the system, which Arrow and the C library would keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over a task's batches, with free memory given back once the task has its last one.

    Spark keeps a Python worker for later tasks, of other steps too; what it holds on to stands
    beside the executor's heap until then.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def with_positions(placed: DataFrame, group: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in the order in which they are stored.

    placed holds __part and __row, spark_partition_id() and monotonically_increasing_id() taken
    after a range sort that starts with the group columns, and must be a stored table. Only one
    row per partition and group that meet reaches the driver: at most partitions plus groups.
    """
    spark = placed.sparkSession
    met = placed.groupBy(*group, "__part").agg(F.min("__row").alias("__low"), F.count(F.lit(1)).alias("__n")).collect()
    seen: dict[tuple, int] = {}
    rows = []
    for r in sorted(met, key=lambda r: r["__part"]):
        key = tuple(r[g] for g in group)
        rows.append((*key, r["__part"], seen.get(key, 0) - r["__low"]))
        seen[key] = seen.get(key, 0) + r["__n"]
    kinds = dict(placed.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ("," if group else "") + " __part int, __shift long"
    shifts = F.broadcast(spark.createDataFrame(rows, schema))  # one row per partition and group that meet
    joined = placed.join(shifts, [*group, "__part"])
    return joined.withColumn(name, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 0 and their number."""
    distinct, found = np.unique(keys, return_inverse=True)
    return found.astype(np.int64), len(distinct)


def packed(columns: list[np.ndarray], count: int) -> tuple[np.ndarray, int]:
    """One number per row of columns of numbers below count, in the rows' order, and a bound on them.

    As many columns as fit go into 62 bits; where several are needed, their ranks are packed again.
    """
    while len(columns) > 1:
        fit = max(2, 62 // max(1, (count - 1).bit_length()))
        groups = [columns[k : k + fit] for k in range(0, len(columns), fit)]
        keys = []
        for group in groups:
            key = group[0]
            for column in group[1:]:
                key = key * count + column
            keys.append(key)
        if len(keys) == 1:
            return keys[0], count ** len(groups[0])
        columns, sizes = zip(*map(ranks, keys))
        count = max(sizes)
    return columns[0], count
