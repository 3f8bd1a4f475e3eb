"""Physical plans: pushdown, pruning, no cartesian product, no one-task sort of raw rows."""

import pytest
from pyspark.sql import functions as F

from gridmill.operators import charts, clean, kpi, profile, timeagg
from gridmill.queries import tables as t


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def lineitem(spark, sf):
    return t.load(spark, sf, "lineitem")


def test_group_total_reads_two_columns(lineitem):
    text = plan_of(kpi.group_agg(lineitem, "l_returnflag", "l_extendedprice"))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text


def test_filters_reach_the_scan(lineitem):
    text = plan_of(clean.filter_rows(lineitem, "l_quantity", "> 49"))
    assert "GreaterThan(l_quantity,49.0)" in text
    spec = {"x": "l_shipdate", "y": "l_quantity", "group": "l_returnflag"}
    assert "In(l_returnflag, [" in plan_of(charts.build_chart(lineitem, "multi_line", spec))


def test_top_k_limits_before_the_shuffle(lineitem):
    text = plan_of(timeagg.top_k_per_group(lineitem, ["l_returnflag"], [F.desc("l_quantity"), F.asc("l_orderkey")], 3))
    assert text.count("WindowGroupLimit") >= 2


def test_sample_is_a_top_n(lineitem):
    assert "TakeOrderedAndProject" in plan_of(clean.sample_n(lineitem, 100, "l_orderkey"))


@pytest.mark.parametrize(
    "build",
    [
        lambda li: profile.eda_stats(li),
        lambda li: profile.profile_columns(li),
        lambda li: kpi.kpis(li),
        lambda li: timeagg.time_rollups(li, "l_shipdate", "l_quantity"),
        lambda li: charts.build_chart(li, "pareto", {"x": "l_suppkey", "y": "l_quantity"}),
        lambda li: charts.build_chart(li, "stacked_bar", {"x": "l_suppkey", "y": "l_quantity", "group": "l_returnflag"}),
    ],
)
def test_no_nested_loop_over_rows(lineitem, build):
    text = plan_of(build(lineitem))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_one_window_sort_for_all_series_features(spark, sf):
    o = t.load(spark, sf, "orders")
    text = plan_of(timeagg.prepare_time_series(o, "o_orderdate", "o_totalprice", by=["o_orderpriority"], tiebreak="o_orderkey"))
    assert text.count("Exchange hashpartitioning") <= 2  # tree and detail list one exchange
