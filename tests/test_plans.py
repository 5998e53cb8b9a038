"""The plans of registered queries: what they scan, move and hold."""

import pytest

from storelens.operators import weekly
from storelens.sources.orders import write_orders
from storelens.sources.warehouse import retail_orders
from verification.queries import QUERIES

SF = "/root/testdata/sf0.001"
STREAMS = {"stream_topic_windows", "stream_closed_weeks"}


_PLANS = {}


def plans(spark, name):
    if name not in _PLANS:
        execution = QUERIES[name](spark, SF)._jdf.queryExecution()
        _PLANS[name] = execution.optimizedPlan().toString(), execution.executedPlan().toString()
    return _PLANS[name]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join_and_no_row_python(spark, name):
    _, physical = plans(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in physical


@pytest.mark.parametrize("name", ["top_products_revenue", "list_orders", "chart_top_products", "team_questions", "return_reasons_top5"])
def test_top_lists_keep_only_the_top(spark, name):
    assert "TakeOrderedAndProject" in plans(spark, name)[1]


@pytest.mark.parametrize("name", ["weekly_top5", "vector_topk"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    physical = plans(spark, name)[1]
    assert physical.count("WindowGroupLimit") == 2


def test_weekly_metrics_read_the_orders_once(spark):
    for name in ("weekly_metrics", "weekly_alerts", "weekly_series", "daily_sales_vs_prev", "chart_delivery_hist",
                 "repeat_return_products", "cancellations_rollup", "weekly_category_share"):
        physical = plans(spark, name)[1]
        assert physical.count("/orders.parquet") == 1 and physical.count("lineitem.parquet") <= 1, name


def test_question_counts_need_no_tools(spark):
    assert "Join" not in plans(spark, "team_questions")[0]


def test_sums_are_partial_before_the_shuffle(spark):
    physical = plans(spark, "sales_by_country")[1]
    assert "partial_sum" in physical and "HashAggregate" in physical


def test_lines_are_summed_without_a_sort(spark):
    for name in ("weekly_metrics", "top_products_revenue", "returns_report"):
        assert "SortAggregate" not in plans(spark, name)[1], name


def test_no_table_is_joined_that_a_query_does_not_use(spark):
    for name in ("sales_overview", "orders_by_status_counts", "sales_by_month", "last_closed_week", "week_snap"):
        assert "lineitem.parquet" not in plans(spark, name)[1] and "customer.parquet" not in plans(spark, name)[1], name
    assert "part.parquet" not in plans(spark, "weekly_metrics")[1]


def test_every_order_is_in_the_view(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    view = retail_orders(spark, SF)
    assert view.count() == orders.count() == view.select("order_id").distinct().count()


def test_building_a_query_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    built = ("list_orders", "list_orders_in_country", "week_snap", "report_audit", "weekly_metrics", "sales_by_country")
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for name in built:
            QUERIES[name](spark, SF)
        jobs = tracker.getJobIdsForGroup("building")
        # Only the footers of the tables are read, for their columns.
        assert all(len(tracker.getJobInfo(j).stageIds) == 1 and tracker.getStageInfo(tracker.getJobInfo(j).stageIds[0]).numTasks == 1 for j in jobs)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_order_reads_its_own_lines(spark):
    physical = plans(spark, "order_lookup")[1]
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        scan = next(line for line in physical.splitlines() if f"/{table}.parquet" in line)
        assert f"EqualTo({key},7)" in scan.split("PushedFilters")[1]


def test_listed_orders_are_found_before_they_are_completed(spark):
    """The first top-k stands over the orders alone; lines are only summed for its keys."""
    optimized = plans(spark, "list_orders")[0]
    assert optimized.count("GlobalLimit") >= 2 and "LeftSemi" in optimized


def test_a_summary_reads_five_weeks(spark, tmp_path):
    path = str(tmp_path / "orders")
    write_orders(retail_orders(spark, SF), path)
    summary = weekly.report_summary(spark.read.parquet(path))
    summary.collect()
    final = summary._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in final.splitlines() if "FileScan" in line and "return_request_date" in line)
    assert "order_date" in scan.split("DataFilters")[1].split("Format")[0] and "subquery" in scan
    assert weekly.report_summary(spark.read.parquet(path).limit(0)).collect() == []
