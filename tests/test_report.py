from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from storelens.functions.dates import week_end
from storelens.operators import charts, sales, weekly
from storelens.plans.audit import AuditError, audit_report, require_match
from storelens.plans import weekly_report as report_module
from storelens.plans.weekly_report import closing_sunday, publish_report, read_report, weekly_report
from storelens.operators.week_facts import touching_week, week_facts
from storelens.sources.orders import write_orders
from storelens.sources.warehouse import retail_orders
from tests.conftest import rows
from tests.test_weekly import Plain, last_sunday, random_orders

SF = "/root/testdata/sf0.001"
STATUS_COUNTS = {"delivered": 1354, "cancelled": 114, "in_transit": 9, "shipped": 6, "processing": 2}


@pytest.fixture(scope="module")
def made():
    return random_orders(7)


@pytest.fixture(scope="module")
def df(made, make_orders):
    return make_orders(*made)


def test_audit_agrees_for_all_weeks_and_for_one(df, made):
    metrics = weekly.weekly_metrics(df)
    everything = audit_report(df, metrics)
    require_match(everything)
    assert everything.count() == 4 * metrics.count()
    last = last_sunday(max(o["order_date"] for o in made if o["order_date"]))
    one = {r["metric"]: r for r in audit_report(df, metrics, last).collect()}
    p = Plain(made, last)
    assert {k: float(r["audit_value"]) for k, r in one.items()} == {
        "revenue": p.m["revenue"], "orders": len(p.sold), "cancelled": len(p.cancelled), "filed": len(p.filed),
    }
    assert all(r["matches"] for r in one.values())


def test_audit_catches_a_wrong_report(df):
    metrics = weekly.weekly_metrics(df)
    wrong = metrics.withColumn("orders", F.col("orders") + F.when(F.col("orders") > 5, 1).otherwise(0))
    with pytest.raises(AuditError, match="orders: report"):
        require_match(audit_report(df, wrong))
    # A penny is tolerated to less than 0.01, a missing week is not.
    first = metrics.agg(F.min("week_end")).first()[0]
    with pytest.raises(AuditError, match=str(first)):
        require_match(audit_report(df, metrics.where(F.col("week_end") != F.lit(first))))


def test_closing_sunday(df, made):
    last = last_sunday(max(o["order_date"] for o in made if o["order_date"]))
    assert closing_sunday(df) == closing_sunday(df, "2040-01-01") == last
    assert closing_sunday(df, last - timedelta(days=9)) == last - timedelta(days=7)


def test_report_is_one_week_and_gets_published(spark, df, made, tmp_path):
    day = last_sunday(max(o["order_date"] for o in made if o["order_date"])) - timedelta(days=8)
    publish_report(df, str(tmp_path), day)
    sunday = day + timedelta(days=(6 - day.weekday()) % 7)
    report = weekly_report(df, sunday)
    assert len(report) == 22
    published = read_report(spark, str(tmp_path))
    assert set(published) == {*report, "ledger", "facts"}
    for name, table in report.items():
        stored = published[name]
        key = "cutoff" if "cutoff" in stored.columns else "week_end"
        assert {r[0] for r in stored.select(key).distinct().collect()} <= {sunday}, name
        # Sections made of stored facts equal those made of the orders.
        assert sorted(rows(stored), key=str) == sorted(rows(table), key=str), name
    stored = published["metrics"].collect()
    assert [r["orders"] for r in stored] == [len(Plain(made, sunday).sold)]


def test_a_failed_run_leaves_the_report_before_it(spark, df, tmp_path, monkeypatch):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    publish_report(df, path)
    before = {name: sorted(map(str, t.collect())) for name, t in read_report(spark, path).items()}
    sunday = closing_sunday(df)

    def failing(orders, *_):
        return orders.select(F.raise_error(F.lit("broken section")).alias("week_end"))

    with monkeypatch.context() as m:
        m.setitem(report_module._FROM_FACTS, "top_products", failing)
        with pytest.raises(Exception, match="broken section"):
            publish_report(df, path, sunday - timedelta(days=7))
    with monkeypatch.context() as m:
        m.setitem(report_module._FROM_LEDGER, "metrics", lambda orders, ledger: weekly.weekly_metrics(orders, ledger).withColumn("orders", F.col("orders") + 1))
        with pytest.raises(AuditError):
            publish_report(df, path, sunday - timedelta(days=7))
    assert {name: sorted(map(str, t.collect())) for name, t in read_report(spark, path).items()} == before
    publish_report(df, path, sunday - timedelta(days=7))
    assert {r["week_end"] for r in read_report(spark, path)["metrics"].collect()} == {sunday - timedelta(days=7)}


def test_one_week_of_facts_equals_that_week_of_all(df, made):
    sunday = last_sunday(max(o["order_date"] for o in made if o["order_date"])) - timedelta(days=14)
    one = weekly.week_facts(touching_week(df, sunday)).where(F.col("week_end") == F.lit(sunday))
    every = weekly.week_facts(df).where(F.col("week_end") == F.lit(sunday))
    assert one.count() > 10 and sorted(rows(one), key=str) == sorted(rows(every), key=str)
    days = weekly.daily_sales_vs_previous(df).where(F.col("week_end") == F.lit(sunday))
    assert sorted(rows(weekly.daily_sales_vs_previous(df, sunday))) == sorted(rows(days))


def test_days_of_a_week_without_orders(df):
    quiet = weekly.daily_sales_vs_previous(df, date(2031, 1, 5))
    assert [float(r[0]) for r in rows(quiet, "revenue")] == [0.0] * 7


def test_no_orders_no_report(df, tmp_path):
    with pytest.raises(ValueError, match="no week"):
        publish_report(df.where("order_id = 'none'"), str(tmp_path))


def test_report_reads_parts_of_the_stored_orders(spark, df, tmp_path):
    write_orders(df, str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    facts = week_facts(touching_week(stored, date(2026, 2, 1)))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Or(And(GreaterThanOrEqual(order_date,2026-01-26),LessThanOrEqual(order_date,2026-02-01))" in plan


def test_report_with_team_sections(spark, df):
    asked = spark.createDataFrame([("q", [("top_products", 2)])], "question string, tools array<struct<tool:string,calls:bigint>>")
    report = weekly_report(df, closing_sunday(df), interactions=asked)
    assert rows(report["team_questions"]) == [("q", 1)]
    assert rows(report["team_topics"]) == [("Sales & products", 2, 1.0)]
    assert rows(report["team_interactions"]) == [(1,)]


# ---- invariants over the driver tables ------------------------------------------


@pytest.fixture(scope="module")
def retail(spark):
    df = retail_orders(spark, SF).persist()
    yield df
    df.unpersist()


def test_view_counts(retail):
    counts = dict(rows(sales.orders_by_status_counts(retail)))
    assert retail.count() == retail.select("order_id").distinct().count() == 1500
    assert counts == STATUS_COUNTS and sum(counts.values()) == 1500 - retail.where("order_status is null").count()
    assert retail.where("product is null").count() == 27 and retail.where("country is null").count() == 16


def test_breakdowns_add_up_to_the_overview(retail):
    """Orders without a key are in the overview, but in no row of the breakdown."""
    for dimension in ("month", "country", "category", "payment_method", "shipping_zone"):
        key = "order_date" if dimension == "month" else dimension
        revenue, orders = rows(sales.sales_overview(retail.where(F.col(key).isNotNull())), "revenue", "orders")[0]
        table = rows(sales.sales_breakdown(retail, dimension), "revenue", "orders")
        assert (sum(r[0] for r in table), sum(r[1] for r in table)) == (revenue, orders)


def test_shares_add_up_to_100(retail):
    """Up to the share of orders without a key, which only the total row counts."""
    for table, key in ((weekly.weekly_category_share(retail), "category"), (weekly.weekly_country_share(retail), "country"),
                       (weekly.weekly_payment_share(retail), "payment_method")):
        missing = retail.where(F.col(key).isNull()).select(week_end("order_date").alias("week_end")).distinct()
        sums = table.groupBy("week_end").agg(F.sum("share_pct").alias("s")).join(missing, "week_end", "left_anti")
        assert sums.count() > 300 and sums.where(F.abs(F.col("s") - 100) > 1e-6).count() == 0
    totals = weekly.weekly_country_table(retail).where("is_total").select("week_end", F.col("revenue").alias("total"))
    weeks = weekly.weekly_metrics(retail).join(totals, "week_end")
    assert weeks.where("total <> revenue").count() == 0 and weeks.count() > 300


def test_days_add_up_to_weeks(retail):
    daily = weekly.daily_sales_vs_previous(retail).groupBy("week_end").agg(F.sum("revenue").alias("days"))
    weeks = weekly.weekly_metrics(retail)
    both = weeks.join(daily, "week_end", "full")
    assert both.where(~F.col("days").eqNullSafe(F.col("revenue"))).count() == 0
    assert weeks.count() == 343 + 1


def test_histogram_adds_up(retail):
    hist = charts.chart_series(retail, "delivery_days_hist").agg(F.sum("orders")).first()[0]
    assert hist == retail.where("delivery_days is not null").count()


def test_audit_on_driver_tables(retail):
    require_match(audit_report(retail, weekly.weekly_metrics(retail)))


def test_backlog_on_driver_tables(retail):
    assert rows(weekly.backlog(retail)) == [(date(2001, 7, 29), 12, 6, 20, 2, 1)]
