import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.numbering import number_in_order
from panelwright.operators import columns, compare, joins
from panelwright.session import scratch_path
from panelwright.sources import csv


def text_file(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_multi_line_csv_with_mark_and_trailing_comma(spark, tmp_path):
    text = (
        "﻿\"Place Key\",\"Zone\",\"LongRemark\",\r\n"
        "\"QAA\",\"North Reach\",\"\",\r\n"
        "\"QBB\",\"\",\"a first line, then; \nsecond line \"\"quoted\"\"\",\r\n"
        "\"QCC\",\"Île d'Écho\",\"x\",\r\n"
    )
    df = csv.read_csv(spark, text_file(tmp_path, text), multi_line=True, sanitize=True)
    assert df.columns == ["place_key", "zone", "longremark"]
    rows = {r.place_key: r for r in df.collect()}
    assert rows["QBB"].longremark.replace("\r", "") == "a first line, then; \nsecond line \"quoted\""
    assert rows["QCC"].zone == "Île d'Écho" and len(rows) == 3
    schema = "`Place Key` string, Zone string, LongRemark string"
    typed = csv.read_csv(spark, str(tmp_path / "t.csv"), schema, multi_line=True, trailing_comma=True)
    assert typed.columns == ["Place Key", "Zone", "LongRemark"] and typed.count() == 3
    aggregates = typed.filter("Zone is null or Zone = ''").select("Place Key")
    assert [r[0] for r in columns.exclude(typed.select(typed["Place Key"].alias("c")), "c", aggregates).collect()] == ["QAA", "QCC"]


def test_missing_marker_and_awkward_names(spark, tmp_path):
    path = text_file(tmp_path, "Country,Dystopia (1.88) + residual,Explained by: GDP per capita\nA,1.5,NA\nB,NA,2\n")
    df = csv.read_csv(spark, path)
    assert df.columns[1] == "Dystopia (1.88) + residual" and dict(df.dtypes)[df.columns[2]] == "int"
    assert csv.sanitize_names(df).columns == ["country", "dystopia_1_88_residual", "explained_by_gdp_per_capita"]
    kept = columns.project(df, ["Country", "Dystopia (1.88) + residual"])
    assert [tuple(r) for r in kept.orderBy("Country").collect()] == [("A", 1.5), ("B", None)]
    renamed = columns.rename(df, {"Dystopia (1.88) + residual": "HI-Dystopia (1.88) + residual", "absent": "x"})
    assert columns.drop(renamed, ["HI-Dystopia (1.88) + residual", "absent"]).columns == [df.columns[0], df.columns[2]]
    with pytest.raises(Exception, match="header"):
        csv.read_csv(spark, path, "Land string, a double, b double").collect()


def test_equal_clean_names_are_numbered(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "A-B", "?"])
    assert csv.sanitize_names(df).columns == ["a_b", "a_b_2", "column"]


def test_csv_partitioned_by_cluster(spark):
    path = scratch_path(spark, "test-csv")
    df = spark.createDataFrame([(1, "a", None), (2, "b", 'say "x", y'), (1, "c", " z ")], "cluster int, k string, v string")
    csv.write_csv(df, path, partition_by=["cluster"])
    back = csv.read_csv(spark, path, "k string, v string").select("cluster", "k", "v")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_dates(spark):
    df = spark.createDataFrame([("2020-06-20",), ("20.06.2020",)], "date string")
    assert [r.date for r in columns.parse_date(df, "date", bad="null").collect()] == [dt.date(2020, 6, 20), None]
    with pytest.raises(Exception):
        columns.parse_date(df, "date").collect()


def test_lists(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    listed = spark.createDataFrame([("a",), (None,)], "other string")
    assert [r.k for r in columns.exclude(df, "k", ["a"]).collect()] == ["b"]
    assert [r.k for r in columns.exclude(df, "k", listed).collect()] == ["b"]
    assert [r.k for r in columns.keep(df, "k", listed).collect()] == ["a"]
    assert columns.exclude(df, "k", []).count() == 2  # a missing value is never kept, whatever the list


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    assert columns.require_unique(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="missing or repeated"):
        columns.require_unique(df, ["a"])
    with pytest.raises(ValueError):
        columns.require_unique(df.select(F.nullif("a", F.lit(2)).alias("a"), "b"), ["a", "b"])


def test_left_joins_small_and_large(spark):
    fact = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(0, 40).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    small = joins.left_join(fact, dim, [("k", "key")])
    large = joins.left_join(fact, dim, [("k", "key")], broadcast_rows=0)
    assert small.columns == large.columns == ["k", "id", "v"]
    assert small.count() == 2000 and small.exceptAll(large).count() == 0 and large.count() == 2000
    assert small.filter("v is null").count() == fact.filter("k >= 40").count()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="both sides"):
        joins.left_join(fact, dim.withColumnRenamed("v", "id"), [("k", "key")])
    chained = joins.enrich(fact, [joins.Dimension(dim, "k", "key"), joins.Dimension(
        spark.createDataFrame([(70, "x")], "w long, name string"), "v", "w")])
    assert chained.filter("name = 'x'").count() == fact.filter("k = 7").count()


def test_equal_rows_of_a_hot_key_are_split(spark):
    """A partition of equal rows is divided by the tasks that wrote it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(0, 100_000, 1, 8).select(F.lit(7).cast("long").alias("k"), F.lit("same").alias("v"))
        rest = spark.range(0, 100, 1, 2).select(F.col("id").alias("k"), F.lit("x").alias("v"))
        dim = spark.range(0, 1000).select(F.col("id").alias("key"), F.col("id").cast("string").alias("w"))
        out = joins.left_join(hot.union(rest), dim, [("k", "key")], broadcast_rows=0)
        assert out.groupBy(F.spark_partition_id()).count().filter("count > 80000").isEmpty()
        assert out.count() == 100_100 and out.filter("w is null").isEmpty()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_few_but_wide_rows_are_not_broadcast(spark, monkeypatch):
    fact = spark.range(20).select(F.col("id").alias("k"))
    dim = spark.range(10).select(F.col("id").alias("key"), F.lit("x" * 100).alias("text"))
    assert joins._stored(dim, 10)[1] and not joins._stored(dim, 9)[1]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 999)
    assert not joins._stored(dim, 10)[1] and joins._stored(dim.drop("text"), 10)[1]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 79)
    assert not joins._stored(dim.drop("text"), 10)[1]  # numbers have a width as well
    assert joins.left_join(fact, dim, [("k", "key")]).filter("text is not null").count() == 10


def test_dimensions_run_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    dim = spark.range(10).select(F.col("id").alias("key"), F.lit(1).alias("v")).mapInPandas(count, "key long, v int")
    assert joins.left_join(spark.range(5).toDF("k"), dim, [("k", "key")]).count() == 5
    assert seen.value == 10


def test_a_plain_column_name_of_the_callers_is_kept(spark, tmp_path):
    path = text_file(tmp_path, "a,_c1,b\n1,2,3\n")
    df = csv.read_csv(spark, path, "a int, _c1 int, b int")
    assert [tuple(r) for r in df.collect()] == [(1, 2, 3)] and df.columns == ["a", "_c1", "b"]
    ends = text_file(tmp_path, "a,_c1\n1,2\n", "ends.csv")
    assert csv.read_csv(spark, ends, "a int, _c1 int").columns == ["a", "_c1"]


def test_null_rows_and_empty_lists(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    empty = spark.createDataFrame([], "w int")
    assert [columns.exclude(df, "v", x).count() for x in ([], [1], empty)] == [2, 1, 2]
    assert [columns.keep(df, "v", x).count() for x in ([], [1], empty)] == [0, 1, 0]


def test_repeated_labels_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    labels = spark.createDataFrame([(1, 4), (1, 5), (2, 6)], "id int, cluster int")
    with pytest.raises(Exception, match="several labels for 1"):
        compare.attach_labels(df, labels, "id").collect()


def test_numbering(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("id")).repartition(6)
    got = number_in_order(df, [F.col("id").desc()], "n")
    assert got.filter("n != 500 - id").count() == 0 and got.count() == 500


def test_labels(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 1), (4, 2, 2), (5, None, 1)], "id int, a int, b int")
    swap = {r.id: r.b for r in compare.relabel(df, "b", {1: 2, 2: 1}).collect()}
    assert swap == {1: "1", 2: "1", 3: "2", 4: "1", 5: "2"}
    match = compare.best_match(df, "b", "a")
    assert {tuple(r) for r in match.collect()} == {(2, 1, 2), (1, 2, 1)}
    assert {r.id: r.b for r in compare.relabel(df, "b", match).collect()} == swap
    labels = spark.createDataFrame([(1, 4), (3, 5)], "id int, cluster int")
    assert compare.attach_labels(df, labels, "id").count() == 5
    assert compare.attach_labels(df, labels, "id", only_labelled=True).count() == 2
    assert compare.part(compare.attach_labels(df, labels, "id"), "cluster", 5).first().id == 3
    assert {tuple(r) for r in compare.crosstab(df, "a", "b").collect()} == {(1, 2, 2), (2, 1, 1), (2, 2, 1), (None, 1, 1)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_assigned_against_permutations(n):
    rng = random.Random(n)
    for _ in range(60):
        gain = np.array([[rng.randint(0, 3) for _ in range(n)] for _ in range(n)], dtype=np.int64).reshape(n, n)
        best = min(itertools.permutations(range(n)), key=lambda p: (-sum(gain[i, j] for i, j in enumerate(p)), p))
        assert tuple(compare.assigned(gain)) == best


def test_assignment(spark, monkeypatch):
    rows = [("p", 1)] * 5 + [("p", 2)] * 4 + [("q", 1)] * 4 + [("r", 1)] * 3 + [("q", None), (None, 2)]
    df = spark.createDataFrame(rows, "a string, b int")
    assert [tuple(r) for r in compare.best_match(df, "a", "b").orderBy("from").collect()] == [("p", 1, 5), ("q", 1, 4), ("r", 1, 3)]
    assert [tuple(r) for r in compare.assignment(df, "a", "b").orderBy("from").collect()] == [("p", 2, 4), ("q", 1, 4), ("r", None, 0)]
    assert [tuple(r) for r in compare.assignment(df, "b", "a").orderBy("from").collect()] == [(1, "q", 4), (2, "p", 4)]
    assert compare.assignment(df.limit(0), "a", "b").count() == 0
    monkeypatch.setattr(compare, "MOST_LABELS", 2)
    with pytest.raises(ValueError, match="3 labels to assign"):
        compare.assignment(df, "a", "b")
