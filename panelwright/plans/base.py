"""The tables behind the queries: a daily panel of users made from the events, and its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import thresholds as th
from panelwright.operators.running import running_sums

THRESHOLDS = (100, 500, 1000, 2000, 3000)
FEATURES = ("total", "bad", "span")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def real(value: Column | str, digits: int = 4) -> Column:
    """A rounded double without negative zero, comparable across engines."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def whole(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.cast("bigint")


def day_text(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: new and cumulative value, new and cumulative errors."""
    daily = (
        load(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("day"))
        .agg(
            F.sum(F.col("value").cast("decimal(18,2)")).alias("new_metric"),
            F.count_if(F.col("event_type") == "error").alias("new_bad"),
        )
    )
    return running_sums(
        daily, ["entity"], "day", {"total_metric": F.col("new_metric"), "total_bad": F.col("new_bad")}
    )


def last_day(spark: SparkSession, sf_dir: str) -> Column:
    return th.latest(load(spark, sf_dir, "events").select(F.to_date("ts").alias("day")), "day")


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.threshold_counters(panel(spark, sf_dir), "entity", "day", "total_metric", THRESHOLDS)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: final value, final errors, days from 100 to 1000."""
    run = th.threshold_counters(panel(spark, sf_dir), "entity", "day", "total_metric", THRESHOLDS, buckets=False)
    return run.groupBy("entity").agg(
        F.max("total_metric").cast("double").alias("total"),
        F.max("total_bad").cast("double").alias("bad"),
        F.max(F.when(F.col("day_1000") == 1, F.col("day_100"))).cast("double").alias("span"),
        F.max(F.when(F.col("day_3000") == 1, F.col("day_100"))).cast("double").alias("long_span"),
    )


SIX = (*FEATURES, "mean_value", "top_value", "days")


def six_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three features, and mean and largest value and number of active days of each user."""
    events = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity")).agg(
        F.avg("value").alias("mean_value"),
        F.max("value").alias("top_value"),
        F.count_distinct(F.to_date("ts")).cast("double").alias("days"),
    )
    return features(spark, sf_dir).select("entity", *FEATURES).join(events, "entity")


EXACT = ("total", "bad", "span", "top_value", "days", "moves")


def exact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six features without rounding of their own, so that ties of distances are ties in any engine."""
    events = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity")).agg(
        F.max("value").alias("top_value"),
        F.count_distinct(F.to_date("ts")).cast("double").alias("days"),
        F.count(F.lit(1)).cast("double").alias("moves"),
    )
    table = features(spark, sf_dir).join(events, "entity")
    return table.withColumn("total", F.col("total") / 64).select("entity", *EXACT, "long_span")


def label_a() -> Column:
    """A fixed grouping by final value; none for the outliers."""
    total = F.col("total")
    return F.when(total < 2900, 1).when(total < 3300, 2).when(total < 3650, 3).when(total < 4000, 4)


def label_b() -> Column:
    """A fixed grouping by speed."""
    span = F.col("span")
    return F.when(span <= 6, 3).when(span <= 7, 1).when(span <= 9, 2).otherwise(4)


def entity_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer that ordered: balance in thousands and number of orders."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    customers = load(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), "c_nationkey"
    )
    joined = customers.join(orders, customers.c_custkey == orders.o_custkey, "left")
    return joined.select(F.col("c_custkey").alias("entity_key"), "balance", "n_orders")
