"""Shape of the physical plans: what reaches the scan, how often rows are shuffled."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import columns, joins, regression, stats
from panelwright.operators import thresholds as th
from panelwright.plans import base, queries

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(columns.exclude(base.load(spark, SF, "lineitem"), "l_returnflag", ["N"]).select("l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(l_returnflag)" in text and "Exchange" not in text


def test_panel_reads_only_its_columns(spark):
    text = plan(base.panel(spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_counters_add_no_shuffle_to_the_panel(spark):
    run = base.running(spark, SF)
    assert plan(run).count("Exchange hashpartitioning") == plan(base.panel(spark, SF)).count("Exchange hashpartitioning")
    spans = th.durations(run, "entity", base.THRESHOLDS)
    assert plan(spans).count("Exchange hashpartitioning") == plan(run).count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["threshold_counter", "cluster_profile", "dim_enrich", "ols_by_group", "cluster_crosstab"])
def test_no_step_on_a_single_partition(spark, name):
    assert "SinglePartition" not in plan(queries.QUERIES[name](spark, SF))


def test_regression_reads_the_data_once_and_shuffles_aggregates_only(spark):
    lines = base.load(spark, SF, "lineitem")
    text = plan(regression.ols(lines, queries.LINE_MODEL, by=["l_returnflag"]))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "partial_covar_pop" in text


def test_standardize_reads_its_facts_as_one_subquery(spark):
    df = stats.standardize(base.load(spark, SF, "lineitem"), ["l_quantity", "l_tax"])
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("HashAggregate(keys=[], functions=[avg") == 1 and "ReusedSubquery" in final


def test_large_dimensions_of_one_key_shuffle_the_panel_once(spark):
    panel = base.load(spark, SF, "lineitem").select("l_orderkey", "l_quantity")
    one = base.load(spark, SF, "orders").select("o_orderkey", "o_totalprice")
    two = one.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("again"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(joins.enrich(panel, [
            joins.Dimension(one, "l_orderkey", "o_orderkey"), joins.Dimension(two, "l_orderkey", "key")
        ], broadcast_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 3
