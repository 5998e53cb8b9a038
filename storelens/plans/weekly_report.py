"""The weekly report as tables: built together, audited, written side by side."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.dates import last_closed_sunday, week_end
from storelens.operators import team, weekly
from storelens.operators.ledger import weekly_ledger
from storelens.operators.sales import as_date
from storelens.operators.week_facts import touching_week, week_facts
from storelens.plans.audit import audit_report, require_match
from storelens.sources.published import latest_folder, publish

_FROM_LEDGER = {
    "metrics": weekly.weekly_metrics,
    "summary": weekly.weekly_summary,
    "deltas": weekly.weekly_deltas,
    "vs_average": weekly.weekly_vs_avg4,
    "series": weekly.weekly_series,
    "decline_streak": weekly.decline_streak,
    "alerts": weekly.weekly_alerts,
    "returns_controllable": weekly.returns_controllable,
    "backlog": weekly.weekly_backlog,
}
_FROM_FACTS = {
    "category_share": weekly.weekly_category_share,
    "country_share": weekly.weekly_country_share,
    "payment_share": weekly.weekly_payment_share,
    "country_table": weekly.weekly_country_table,
    "payment_table": weekly.weekly_payment_table,
    "top_products": weekly.weekly_top_products,
    "cancellations": weekly.cancellations_rollup,
    "cancellation_concentration": weekly.cancellation_concentration,
    "return_buckets": weekly.return_buckets,
    "return_reasons": weekly.weekly_return_reasons,
    "return_status": weekly.weekly_return_status,
    "repeat_returns": weekly.repeat_return_products,
}


def closing_sunday(orders: DataFrame, week_ending: date | str | None = None) -> date | None:
    """The week to report: the last closed one, or the one a given day belongs to."""
    closed = last_closed_sunday(F.max("order_date"))
    day = as_date(week_ending)
    wanted = F.least(week_end(F.lit(day)), closed) if day else closed
    return orders.agg(wanted).first()[0]


def weekly_report(
    orders: DataFrame,
    sunday: date,
    interactions: DataFrame | None = None,
    ledger: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All report tables of the closed week ending on `sunday`.

    Sections read the `ledger` and the week's `facts` where these have been stored,
    as `publish_report` does, and the orders otherwise.
    """
    if facts is None:
        facts = week_facts(touching_week(orders, sunday))
    report = {name: section(orders, ledger) for name, section in _FROM_LEDGER.items()}
    report |= {name: section(orders, facts) for name, section in _FROM_FACTS.items()}
    report["daily_sales"] = weekly.daily_sales_vs_previous(orders, sunday)
    for name, table in report.items():
        key = "cutoff" if "cutoff" in table.columns else "week_end"
        report[name] = table.where(F.col(key) == F.lit(sunday))
    if interactions is not None:
        report["team_questions"] = team.team_questions(interactions)
        report["team_topics"] = team.team_topics(interactions)
        report["team_interactions"] = team.interaction_count(interactions)
    return report


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """Write one Parquet table per report section under `path`, a folder of their own."""
    for name, table in report.items():
        table.write.parquet(f"{path}/{name}")


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of the report published last under `path`, all of one run."""
    folder = latest_folder(spark, path)
    return {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in spark.read.parquet(f"{folder}/sections").collect()}


def publish_report(
    orders: DataFrame,
    path: str,
    week_ending: date | str | None = None,
    interactions: DataFrame | None = None,
) -> None:
    """Write the report, recompute its figures from the orders, and publish it if they agree.

    `orders` should be a stored table (`write_orders`). It is read whole once, for the
    ledger, and twice in part, for the facts of the week and the days of two weeks.
    The ledger and the facts are written first; all other sections are made of them,
    so a lost executor never sends a section back to the orders. All tables of a run lie
    in its own folder, which is noted last: a run that fails on the way, or whose figures
    differ, changes nothing for readers.
    """
    spark = orders.sparkSession
    sunday = closing_sunday(orders, week_ending)
    if sunday is None:
        raise ValueError("no dated order, so there is no week to report")

    def write(folder: str) -> None:
        base = {"ledger": weekly_ledger(orders), "facts": week_facts(touching_week(orders, sunday))}
        write_report(base, folder)
        stored = {name: spark.read.parquet(f"{folder}/{name}") for name in base}
        report = weekly_report(orders, sunday, interactions, **stored)
        write_report(report, folder)
        require_match(audit_report(orders, spark.read.parquet(f"{folder}/metrics"), sunday))
        spark.createDataFrame([(name,) for name in [*base, *report]], "name string").write.parquet(f"{folder}/sections")

    publish(spark, path, write)
