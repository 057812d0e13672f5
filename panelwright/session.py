"""Session settings for local runs, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwright")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Recording the Python line of every column expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_BASE: str | None = None


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or one temporary folder in local mode without it.

    The setting is static, so it is only read here; the local folder is remembered in this module
    and removed when the process ends.
    """
    global _LOCAL_BASE
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _LOCAL_BASE is None:
        _LOCAL_BASE = tempfile.mkdtemp(prefix="panelwright-")
        atexit.register(shutil.rmtree, _LOCAL_BASE, ignore_errors=True)
    return _LOCAL_BASE


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder the session names in spark.checkpoint.dir."""
    app = spark.sparkContext.applicationId
    return f"{scratch_base(spark)}/panelwright/{app}/{label}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Remove the stored tables that a DataFrame reads, once nothing will read them again.

    Only folders made by scratch_path are touched; a table of the user's is left alone.
    """
    spark = df.sparkSession
    ours = f"/panelwright/{spark.sparkContext.applicationId}/"
    folders = {f[: f.rindex("/")] for f in df.inputFiles() if ours in f}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one round and not all of them, fixes the
    outcome of order-dependent columns, and gives Spark the true size of the table for its
    choice of join.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, label: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    """The same, with the number of rows (or of rows that meet a condition) counted on the way."""
    return write_counted(df, scratch_path(df.sparkSession, label), counted)


def write_counted(df: DataFrame, path: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    seen = Observation()
    rows = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    df.observe(seen, rows.alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def spread(df: DataFrame, work: float, per_task: float) -> DataFrame:
    """Divide a table by the work its rows cause, where that is out of proportion to its bytes.

    Small tables are read as one partition and adaptive execution keeps them so; a fixed number
    of partitions is left alone. A table that has as many partitions already is not touched, so
    the count only ever rises.
    """
    tasks = int(work // per_task)
    return df.repartition(tasks) if tasks > max(1, df.rdd.getNumPartitions()) else df
