"""CSV in and out: verbatim headers, missing markers, multi-line text, clean names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def snake_case(name: str) -> str:
    """Lower-case words joined by underscores, so that dots and blanks need no quoting."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def sanitize_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; equal names get _2, _3 ... in column order."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        clean = snake_case(column) or "column"
        seen[clean] = seen.get(clean, 0) + 1
        names.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean]}")
    return df.toDF(*names)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    *,
    multi_line: bool = False,
    trailing_comma: bool = False,
    null_value: str = "NA",
    sanitize: bool = False,
) -> DataFrame:
    """A CSV table with a header row.

    With a schema the file is read once and the header must carry the schema's names in order;
    without one Spark reads it twice to guess the types, which suits exploration only.
    Quoted fields may hold doubled quotes, and line breaks when multi_line is set (Spark then
    keeps one file per task: write large exports as many files). Lines that end in a comma have
    a nameless last column, which is dropped; with a schema, say so by trailing_comma.
    """
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
        if trailing_comma:
            schema = schema.add(f"_c{len(schema)}", T.StringType())
    reader = (
        spark.read.option("header", True)
        .option("nullValue", null_value)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", schema is None or trailing_comma)
        .option("encoding", "UTF-8")
    )
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    last = f"_c{len(df.columns) - 1}"
    nameless = df.columns[-1] == last and (schema is None or trailing_comma)
    df = df.drop(last) if nameless else df
    return sanitize_names(df) if sanitize else df


def write_csv(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    null_value: str = "NA",
    mode: str = "errorifexists",
) -> None:
    """A folder of CSV files with headers, one subfolder per value of the partition columns."""
    writer = (
        df.write.mode(mode)
        .option("header", True)
        .option("nullValue", null_value)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
