import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import thresholds as th
from panelwright.operators.running import running_sums

SCHEMA = "entity string, date date, metric double"
START = dt.date(2020, 3, 1)


def table(spark, **series):
    rows = []
    for entity, values in series.items():
        for i, v in enumerate(values):
            if v != "absent":
                rows.append((entity, START + dt.timedelta(days=i), None if v is None else float(v)))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def counters(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("date").collect()]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([50, 100, 150], [0, 1, 2]),
        ([100, 90, 120], [1, 0, 2]),
        ([100, None, 120], [1, None, 2]),
        ([100, "absent", 120], [1, 2]),
        ([10, 20], [0, 0]),
    ],
)
def test_counter(spark, values, expected):
    run = th.threshold_counters(table(spark, a=values), "entity", "date", "metric", [100])
    assert [c for (c,) in counters(run, "day_100")] == expected


def test_buckets_and_double_crossing(spark):
    run = th.threshold_counters(table(spark, a=[50, 1500]), "entity", "date", "metric", [100, 1000])
    assert counters(run, "bucket_100", "bucket_1000", "day_100", "day_1000") == [
        ("<100", "<1000", 0, 0),
        (">=100", ">=1000", 1, 1),
    ]
    assert th.durations(run, "entity", [100, 1000]).first()["days_100_to_1000"] == 1


def test_never_crossing_gives_null_duration(spark):
    run = th.threshold_counters(table(spark, a=[10, 20], b=[100, 20]), "entity", "date", "metric", [100, 1000])
    assert {r["days_100_to_1000"] for r in th.durations(run, "entity", [100, 1000]).collect()} == {None}


def test_repeated_entity_and_date_fails(spark):
    df = table(spark, a=[1, 2]).union(table(spark, a=[3]))
    run = th.threshold_counters(df, "entity", "date", "metric", [100])
    with pytest.raises(Exception, match="two rows of one entity"):
        run.agg(F.sum("day_100")).collect()


def random_panel(spark, seed, entities=12, days=90):
    rng = random.Random(seed)
    series = {}
    for e in range(entities):
        level, values = 0.0, []
        for _ in range(days):
            level = max(0.0, level + rng.uniform(-20, 60))
            values.append(rng.choices([round(level, 2), None, "absent"], [8, 1, 1])[0])
        series[f"e{e}"] = values
    return table(spark, **series)


def literal_counter(df, t):
    """The row number inside (entity, bucket), as the definition says."""
    bucket = F.when(F.col("metric") < t, f"<{t}").when(F.col("metric") >= t, f">={t}")
    w = Window.partitionBy("entity", bucket).orderBy("date")
    number = F.row_number().over(w)
    return df.withColumn(f"lit_{t}", F.when(F.col("metric") < t, 0).when(F.col("metric") >= t, number))


def test_running_count_equals_row_number_in_bucket(spark):
    marks = [100, 400, 900]
    df = random_panel(spark, 7)
    run = th.threshold_counters(df, "entity", "date", "metric", marks)
    for t in marks:
        run = literal_counter(run, t)
    wrong = F.lit(False)
    for t in marks:
        wrong = wrong | ~F.col(f"day_{t}").eqNullSafe(F.col(f"lit_{t}"))
    assert run.count() == df.count()
    assert run.filter(wrong).count() == 0


def test_blocks_of_time_give_the_same_counter(spark):
    df = random_panel(spark, 11)
    plain = th.threshold_counters(df, "entity", "date", "metric", [100, 400])
    block = F.floor(F.datediff("date", F.lit(START)) / 7)
    blocked = th.threshold_counters(df, "entity", "date", "metric", [100, 400], block=block)
    assert plain.exceptAll(blocked).count() == 0 and blocked.exceptAll(plain).count() == 0


def test_timestamps_run_in_blocks(spark):
    rows = [("a", dt.datetime(2020, 1, 1, h // 4, 15 * (h % 4)), 1.0) for h in range(40)]
    df = spark.createDataFrame(rows, "entity string, at timestamp, x double")
    out = running_sums(df, ["entity"], "at", {"total": F.col("x")})
    assert [r.total for r in out.orderBy("at").collect()] == [float(i + 1) for i in range(40)]
    again = spark.createDataFrame(rows + rows[:1], df.schema)
    with pytest.raises(Exception, match="two rows of one entity"):
        running_sums(again, ["entity"], "at", {"total": F.col("x")}).agg(F.sum("total")).collect()


def test_duration_shrinks_with_a_later_start(spark):
    run = th.threshold_counters(random_panel(spark, 3), "entity", "date", "metric", [100, 400, 900])
    d = th.durations(run, "entity", [100, 400, 900])
    assert d.filter("days_400_to_900 > days_100_to_900").count() == 0


def test_one_shuffle_for_all_thresholds(spark):
    run = th.threshold_counters(random_panel(spark, 5), "entity", "date", "metric", [100, 400, 900])
    plan = th.durations(run, "entity", [100, 400, 900])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_sections(spark):
    df = table(spark, a=[100, 200, 300], b=[50, 60, 5000], c=[100, 150])
    run = th.threshold_counters(df, "entity", "date", "metric", [100, 1000])
    last = START + dt.timedelta(days=2)
    names = lambda d: sorted(r.entity for r in d.collect())
    assert names(th.cross_section(run, "date", "max")) == ["a", "b"]
    assert names(th.cross_section(run, "date", last.isoformat(), reached=100)) == ["a", "b"]
    assert names(th.cross_section(run, "date", START, reached=100)) == ["a", "c"]
    assert names(th.first_crossing(run, 1000)) == ["b"]
    assert names(th.day_n_section(run, 100, 2, "metric", 150)) == ["a"]
    assert names(th.significant(th.cross_section(run, "date", "max"), "metric", 300)) == ["a", "b"]
    early = th.durations(run, "entity", [100, 1000], time="date", as_of=START + dt.timedelta(days=1))
    assert early.filter("days_100_to_1000 is not null").count() == 0
    assert th.durations(run, "entity", [100, 1000]).filter("days_100_to_1000 = 1").count() == 1
    joined = th.with_durations(th.cross_section(run, "date", "max"), th.durations(run, "entity", [100, 1000]), "entity")
    assert {r.entity: r.days_100_to_1000 for r in joined.collect()} == {"a": None, "b": 1}
    both = th.label_sections({"first": th.cross_section(run, "date", START), "last": th.cross_section(run, "date", "max")})
    assert {(r.section, r["count"]) for r in both.groupBy("section").count().collect()} == {("first", 3), ("last", 2)}
