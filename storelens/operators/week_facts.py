"""Weekly facts: what the report's breakdowns count, for all of them in one pass.

An order is entered once per breakdown it belongs to, under the week it was placed
or its return was requested in. Entries are summed where the orders lie, so the
shuffle carries one row per breakdown, week, value and task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import lookup, not_cancelled, status_is, total_of
from storelens.functions.dates import week_end
from storelens.lookups import OTHER, RETURN_BUCKETS

BREAKDOWNS = (
    "category", "country", "payment_method", "product", "cancelled_country",
    "return_bucket", "return_reason", "return_status", "returned_product",
)


def week_facts(
    orders: DataFrame, breakdowns: Sequence[str] = BREAKDOWNS, buckets: dict[str, str] = RETURN_BUCKETS
) -> DataFrame:
    """Rows, order ids and value per breakdown, week and value (`key`, NULL included)."""
    sold = F.when(not_cancelled(), week_end("order_date"))
    dropped = F.when(status_is("cancelled"), week_end("order_date"))
    filed = week_end("return_request_date")
    entries = {
        "category": (sold, F.col("category")),
        "country": (sold, F.col("country")),
        "payment_method": (sold, F.col("payment_method")),
        "product": (sold, F.col("product")),
        "cancelled_country": (dropped, F.col("country")),
        "return_bucket": (filed, lookup("return_reason", buckets, OTHER)),
        "return_reason": (filed, F.col("return_reason")),
        "return_status": (filed, F.col("return_status")),
        "returned_product": (filed, F.col("product")),
    }
    marks = [
        F.struct(F.lit(b).alias("breakdown"), entries[b][0].alias("week_end"), entries[b][1].alias("key"))
        for b in breakdowns
    ]
    return (
        orders.select("order_id", "total", F.inline(F.array(*marks)))
        .where(F.col("week_end").isNotNull())
        .groupBy("breakdown", "week_end", "key")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("order_id").alias("order_ids"),
            total_of("total").alias("amount"),
        )
    )


def touching_week(orders: DataFrame, sunday: date) -> DataFrame:
    """Orders placed or returned in one week: all that its facts depend on.

    Plain date bounds, so a stored orders table is read only where they can hold.
    """
    monday = sunday - timedelta(days=6)
    return orders.where(
        F.col("order_date").between(F.lit(monday), F.lit(sunday))
        | F.col("return_request_date").between(F.lit(monday), F.lit(sunday))
    )


def breakdown(orders: DataFrame, facts: DataFrame | None, name: str) -> DataFrame:
    """One breakdown, out of stored facts where given."""
    if facts is None:
        facts = week_facts(orders, [name])
    return facts.where(F.col("breakdown") == name).drop("breakdown")
