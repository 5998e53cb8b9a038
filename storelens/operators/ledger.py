"""The weekly ledger: everything the weekly report counts, one row per closed week.

Each order is read once and entered under up to four weeks: the one it was placed
in, the one its return was requested in and, while it is open, the ones in which it
becomes overdue. Entries are pre-aggregated where the orders lie, so what is
shuffled is at most one row per week and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import lookup, not_cancelled, status_is
from storelens.functions.dates import fill_calendar, last_closed_sunday, week_end
from storelens.lookups import (
    CUSTOMER_BUCKET,
    OTHER,
    PROCESSING_DAYS_LIMIT,
    RETURN_BUCKETS,
    TRANSIT_DAYS_LIMIT,
    TREND_WEEKS,
)

_COUNTS = (
    "placed", "cancelled", "orders", "revenue", "cancelled_value", "units", "instalment_orders",
    "delivery_days_sum", "delivery_days_known", "filed", "filed_value", "filed_controllable",
    "open_entered", "open_overdue", "processing_entered", "processing_overdue",
)


def week_entries(
    orders: DataFrame,
    transit_days: int = TRANSIT_DAYS_LIMIT,
    processing_days: int = PROCESSING_DAYS_LIMIT,
) -> DataFrame:
    """One row per week with any entry, open and stray weeks included."""
    in_transit = F.col("order_status").isin("shipped", "in_transit")
    processing = status_is("processing")
    overdue_on = F.when(in_transit, F.date_add("order_date", transit_days + 1)).when(
        processing, F.date_add("order_date", processing_days + 1)
    )
    days = {"placed": F.col("order_date"), "filed": F.col("return_request_date"), "overdue": overdue_on}
    marks = [F.struct(F.lit(e).alias("entry"), week_end(d).alias("week_end")) for e, d in days.items()]
    entries = orders.select(
        "order_date", "total", "quantity", "installments", "order_status", "delivery_days", "return_reason",
        F.inline(F.array(*marks)),
    ).where(F.col("week_end").isNotNull())

    placed, filed, overdue = (F.col("entry") == e for e in ("placed", "filed", "overdue"))
    sold = placed & not_cancelled()
    dropped = placed & status_is("cancelled")
    arrived = placed & status_is("delivered")
    ours = lookup("return_reason", RETURN_BUCKETS, OTHER) != CUSTOMER_BUCKET
    return entries.groupBy("week_end").agg(
        F.count_if(placed).alias("placed"),
        F.count_if(dropped).alias("cancelled"),
        F.count_if(sold).alias("orders"),
        F.sum(F.when(sold, F.col("total"))).alias("revenue"),
        F.sum(F.when(dropped, F.col("total"))).alias("cancelled_value"),
        F.sum(F.when(sold, F.col("quantity"))).alias("units"),
        F.count_if(sold & (F.col("installments") > 1)).alias("instalment_orders"),
        F.sum(F.when(arrived, F.col("delivery_days"))).alias("delivery_days_sum"),
        F.count(F.when(arrived, F.col("delivery_days"))).alias("delivery_days_known"),
        F.count_if(filed).alias("filed"),
        F.sum(F.when(filed, F.col("total"))).alias("filed_value"),
        F.count_if(filed & ours).alias("filed_controllable"),
        F.count_if(placed & in_transit).alias("open_entered"),
        F.count_if(overdue & in_transit).alias("open_overdue"),
        F.count_if(placed & processing).alias("processing_entered"),
        F.count_if(overdue & processing).alias("processing_overdue"),
        F.min(F.when(placed & in_transit, F.col("order_date"))).alias("oldest_open_date"),
        F.max(F.when(placed, F.col("order_date"))).alias("last_order_date"),
    )


def weekly_ledger(orders: DataFrame, **limits: int) -> DataFrame:
    """One row per closed week, none missing, from 4 weeks before the first order.

    The lead-in weeks give the first weeks their zero history; `first_week` tells
    where the report starts. The windows run over the weekly rows only, and their
    single task sees one row per week of the calendar.
    """
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weeks = week_entries(orders, **limits)
    bounds = weeks.select(
        "*",
        F.min(F.when(F.col("placed") > 0, F.col("week_end"))).over(whole).alias("first_week"),
        last_closed_sunday(F.max("last_order_date").over(whole)).alias("last_week"),
    ).where(F.col("week_end").between(F.col("first_week"), F.col("last_week")))
    dense = fill_calendar(
        bounds,
        "week_end",
        7,
        first=F.date_sub("first_week", 7 * TREND_WEEKS),
        last=F.col("last_week"),
    )
    filled = dense.select(
        "week_end",
        F.max("first_week").over(whole).alias("first_week"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS],
        "oldest_open_date",
    )
    so_far = W.orderBy("week_end").rowsBetween(W.unboundedPreceding, W.currentRow)
    return filled.select(
        F.date_sub("week_end", 6).alias("week_start"),
        "*",
        F.sum("open_entered").over(so_far).alias("open_orders"),
        F.sum("open_overdue").over(so_far).alias("open_aged"),
        F.coalesce(
            F.date_diff("week_end", F.min("oldest_open_date").over(so_far)), F.lit(0)
        ).alias("oldest_open_days"),
        F.sum("processing_entered").over(so_far).alias("processing_orders"),
        F.sum("processing_overdue").over(so_far).alias("processing_aged"),
    )


def ledger_up_to(orders: DataFrame, sunday: Column) -> DataFrame:
    """The counts of the week ending on `sunday` and of the four before it, none missing.

    Only the orders placed or filed in these weeks are read: `sunday` may be a scalar
    subquery, whose value then bounds the scan. No row if it is NULL.
    """
    first = F.date_sub(sunday, 7 * TREND_WEEKS + 6)
    near = F.col("order_date").between(first, sunday) | F.col("return_request_date").between(first, sunday)
    weeks = orders.sparkSession.range(TREND_WEEKS + 1).select(
        F.date_sub(sunday, (7 * F.col("id")).cast("int")).alias("week_end"), sunday.alias("first_week")
    ).where(F.col("week_end").isNotNull())
    return weeks.join(week_entries(orders.where(near)), "week_end", "left").select(
        F.date_sub("week_end", 6).alias("week_start"), "week_end", "first_week", *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS]
    )
