"""What the plans look like, and that hot keys are split."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tidewell.catalogue import QUERIES
from tidewell.catalogue.flows import JOIN_AGG
from tidewell.charts import chart_data
from tidewell.functions.chart import ChartConfig
from tidewell.operators import Agg, filter_rows, group_by, join
from tidewell.operators.history import recent_n, trailing_usage
from tidewell.operators.profile import histogram
from tidewell.operators.quota import quota_admission
from tidewell.plans import run_flow

SF_DIR = "/root/testdata/sf0.001"

# Queries whose result needs a job while they are planned; their plan is a scan of it.
EAGER = {"run_log", "flow_metrics"} | {n for n in QUERIES if n.startswith("st_")}


@pytest.fixture
def no_broadcast(conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_python(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if not name.startswith("quota_admission"):  # decided by a fold over sorted rows
        assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan


def test_quota_admission_holds_no_arrays_and_runs_no_job(spark):
    """One plan, whatever the time range: no list for each hit, no job while it is made."""
    events, quotas = table(spark, "events"), spark.createDataFrame([(1, 5)], "user_id long, quota long")
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup(None))
    plan = plan_of(quota_admission(events, quotas))
    assert set(jobs.getJobIdsForGroup(None)) == before
    assert not any(x in plan for x in ("collect_list", "collect_set", "array<", "Generate"))
    assert plan.count("MapInPandas") == 1


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_bool"](spark, SF_DIR), "formatted")
    assert "GreaterThan(l_quantity,45.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    numeric = plan_of(filter_rows(table(spark, "lineitem"), "l_linenumber").select("l_orderkey"))
    assert "Not(EqualTo(l_linenumber,0))" in numeric
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in numeric


def test_flow_is_one_pruned_plan(spark):
    tables = {n: table(spark, n) for n in ("orders", "customer")}
    plan = plan_of(run_flow(spark, JOIN_AGG, tables).output.df)
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>" in plan
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_group_by_is_one_shuffle_with_partial_aggregation(spark):
    df = group_by(table(spark, "lineitem"), ["l_suppkey"], [Agg(o, "l_quantity") for o in ("sum", "avg", "min", "max", "count")])
    plan = plan_of(df)
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_null_safe_join_is_an_equi_join(spark, no_broadcast):
    orders = table(spark, "orders")
    plan = plan_of(join(orders, orders, "o_custkey", "o_custkey"))
    assert "SortMergeJoin [coalesce(o_custkey" in plan


def test_outer_join_is_split_only_when_the_other_side_is_large(spark, conf):
    orders, customers = table(spark, "orders"), table(spark, "customer")
    assert plan_of(join(orders, customers, "o_custkey", "c_custkey", "left")).count("Join") == 1
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    assert "LeftAnti" in plan_of(join(orders, customers, "o_custkey", "c_custkey", "left"))
    assert "LeftAnti" in plan_of(join(orders, customers, "o_custkey", "c_custkey", "outer"))


def test_recent_n_limits_before_the_shuffle(spark):
    plan = plan_of(recent_n(table(spark, "events"), "user_id", ["ts", "event_id"], 5))
    assert re.search(r"row_number\(\), 5, Partial", plan)


@pytest.mark.parametrize("name", ["limit_ordered", "audit_page", "sort_topk", "multi_search", "chart_default"])
def test_top_k_does_not_sort_everything(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_chart_rows_are_a_top_k(spark):
    df = table(spark, "orders").withColumn("text", F.col("o_custkey").cast("string"))
    plan = plan_of(chart_data(df, ChartConfig("line", "o_orderdate", ("o_totalprice", "text")), ["o_orderdate", "o_orderkey"]))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_histogram_reads_its_bounds_once(spark):
    assert plan_of(histogram(table(spark, "lineitem"))).count("Subquery subquery") <= 2


def test_trailing_usage_spreads_a_key(spark):
    plan = plan_of(trailing_usage(table(spark, "events"), ["user_id"], "ts"))
    assert "Join" not in plan
    assert re.search(r"hashpartitioning\(user_id#\d+L, __bucket", plan)


def skewed(spark, n=200_000):
    """One key holds a third of the rows."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    pad = F.sha2(F.col("id").cast("string"), 512)
    return spark.range(n).select(key.alias("k"), F.col("id").alias("v"), pad.alias("pad"))


@pytest.fixture
def small_skew(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1MB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="512KB",
    )


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("hot", ["left", "right"])
def test_hot_join_key_is_split(spark, small_skew, how, hot):
    big = skewed(spark).repartition(16)
    few = spark.range(0, 60_000, 3).select((F.col("id") + 1).alias("j"), F.col("id").alias("w"))
    few = few.unionAll(spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    left, right, keys = (big, few, ("k", "j")) if hot == "left" else (few, big, ("j", "k"))
    df = join(left, right, *keys, how)
    totals = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"), F.max("pad").alias("pad")]
    sums = df.agg(*totals)
    got = sums.collect()[0]
    assert "skew=true" in plan_of(sums)
    plain = left.join(right, left[keys[0]] == right[keys[1]], how)
    assert got == plain.agg(*totals).collect()[0]
