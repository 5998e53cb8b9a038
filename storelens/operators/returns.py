"""Return requests and their timing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import ratio, status_is
from storelens.operators.sales import count_by, in_period

REQUESTED = "return_request_date"


def returns_report(orders: DataFrame, start_date: date | str | None = None, end_date: date | str | None = None) -> DataFrame:
    """One row: requests over all statuses, delivered orders and the rate between them.

    The period goes by order date. Without a delivered order the rate is NULL.
    """
    totals = in_period(orders, start_date, end_date).agg(
        F.count(REQUESTED).alias("return_requests"),
        F.count_if(status_is("delivered")).alias("delivered_orders"),
    )
    return totals.withColumn("return_rate_delivered", ratio("return_requests", "delivered_orders"))


def return_reasons(
    orders: DataFrame,
    start_date: date | str | None = None,
    end_date: date | str | None = None,
    n: int = 5,
) -> DataFrame:
    """The n most frequent return reasons."""
    return count_by(_requests(orders, start_date, end_date), "return_reason", "requests").limit(n)


def return_status_counts(
    orders: DataFrame, start_date: date | str | None = None, end_date: date | str | None = None
) -> DataFrame:
    """Return requests per resolution status."""
    return count_by(_requests(orders, start_date, end_date), "return_status", "requests")


def late_return_requests(orders: DataFrame, allowed_days: int) -> DataFrame:
    """One row: requests filed more than `allowed_days` after delivery.

    A request without a delivery date counts in the total and is never late.
    """
    days = F.date_diff(REQUESTED, "delivery_date")
    late = days > allowed_days
    counts = orders.where(F.col(REQUESTED).isNotNull()).agg(
        F.count(F.lit(1)).alias("return_requests"),
        F.count_if(late).alias("late_requests"),
        F.avg(F.when(late, days)).alias("mean_days_late"),
    )
    return counts.select(
        "return_requests",
        "late_requests",
        ratio("late_requests", "return_requests").alias("late_share"),
        "mean_days_late",
    )


def _requests(orders: DataFrame, start_date: date | str | None, end_date: date | str | None) -> DataFrame:
    return in_period(orders, start_date, end_date).where(F.col(REQUESTED).isNotNull())
