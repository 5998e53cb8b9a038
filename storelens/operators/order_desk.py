"""Single orders and order lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.lookups import MAX_LISTED


def order_lookup(orders: DataFrame, order_id: str) -> DataFrame:
    """The order with this id, or no row; the earliest one if the id repeats."""
    found = orders.where(F.col("order_id") == order_id.strip().upper())
    return found.orderBy("order_date", "product", "total").limit(1)


def list_orders(
    orders: DataFrame, status: str, country: str = "", limit: int = 20,
    attributes: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Orders of a status, newest first, at most 50, with their age in days.

    The age counts up to the latest order date of the whole table. `status_total`
    is the number of orders of the status in all countries, `match_total` of those
    the list is drawn from. All three come out of one aggregate over two columns
    that the optimizer runs once as a scalar subquery.

    `attributes`, where given, maps the list's order_id to the shown columns (country,
    product, total): the newest orders are then taken first, from `orders` with id, date,
    status and, if one is asked for, country alone, and only those are completed.
    """
    wanted = F.col("order_status") == status.strip().lower()
    listed = wanted
    if country:
        listed = wanted & (F.lower("country") == country.strip().lower())
    totals = orders.agg(
        F.struct(
            F.max("order_date").alias("today"),
            F.count_if(wanted).alias("status_total"),
            F.count_if(listed).alias("match_total"),
        )
    ).scalar()
    limit = min(int(limit), MAX_LISTED)
    newest = (F.desc("order_date"), "order_id")
    shown = [] if attributes else ["country", "product", "total"]
    # Nothing follows the limit: a projection there would turn the top-k into a full sort.
    first = (
        orders.where(listed)
        .select(
            "order_id", "order_date", *shown,
            F.date_diff(totals["today"], "order_date").alias("days_since_order"),
            totals["status_total"].alias("status_total"),
            totals["match_total"].alias("match_total"),
        )
        .orderBy(*newest)
        .limit(limit)
    )
    if not attributes:
        return first
    found = attributes(first.select("order_id")).select("order_id", "country", "product", "total")
    return first.join(found, "order_id", "left").select(
        "order_id", "order_date", "country", "product", "total", "days_since_order", "status_total", "match_total"
    ).orderBy(*newest).limit(limit)
