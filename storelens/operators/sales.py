"""Sales questions over cleaned orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import not_cancelled, ratio, total_of
from storelens.functions.dates import month_label
from storelens.lookups import DIMENSIONS


def as_date(value: date | str | None) -> date | None:
    """An optional ISO date; the empty text means no bound."""
    if value is None or value == "":
        return None
    return value if isinstance(value, date) else date.fromisoformat(value)


def in_period(orders: DataFrame, start_date: date | str | None = None, end_date: date | str | None = None) -> DataFrame:
    """Orders placed from `start_date` to `end_date`, both included and optional."""
    start, end = as_date(start_date), as_date(end_date)
    if start:
        orders = orders.where(F.col("order_date") >= F.lit(start))
    if end:
        orders = orders.where(F.col("order_date") <= F.lit(end))
    return orders


def non_cancelled(orders: DataFrame) -> DataFrame:
    """Orders of every other status, a missing status included."""
    return orders.where(not_cancelled())


def sales_overview(orders: DataFrame, start_date: date | str | None = None, end_date: date | str | None = None) -> DataFrame:
    """One row: period covered (all orders), revenue, orders and mean order value."""
    sold = not_cancelled()
    return in_period(orders, start_date, end_date).agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        total_of(F.when(sold, F.col("total"))).alias("revenue"),
        F.count_if(sold).alias("orders"),
        ratio(
            F.sum(F.when(sold, F.col("total"))), F.count(F.when(sold, F.col("total")))
        ).alias("average_order_value"),
    )


def orders_by_status_counts(
    orders: DataFrame, start_date: date | str | None = None, end_date: date | str | None = None
) -> DataFrame:
    """Orders per status, cancelled included, most frequent first."""
    return count_by(in_period(orders, start_date, end_date), "order_status", "orders")


def count_by(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per value of a column, missing values left out, most frequent first."""
    return counts_of(rows, key, name).orderBy(F.desc(name), key)


def counts_of(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def top_products(
    orders: DataFrame,
    n: int = 5,
    by: str = "revenue",
    start_date: date | str | None = None,
    end_date: date | str | None = None,
) -> DataFrame:
    """The n best products, ranked; any `by` other than 'units' means revenue."""
    measure, name = ("quantity", "units") if by == "units" else ("total", "revenue")
    zero = F.lit(0).cast("bigint" if by == "units" else "decimal(28,2)")
    best = (
        non_cancelled(in_period(orders, start_date, end_date))
        .where(F.col("product").isNotNull() & F.col("category").isNotNull())
        .groupBy("product", "category")
        .agg(F.coalesce(F.sum(measure), zero).alias(name))
        .orderBy(F.desc(name), "product", "category")
        .limit(n)
    )
    return numbered(best, F.desc(name), F.col("product"), F.col("category"))


def numbered(top: DataFrame, *order: Column) -> DataFrame:
    """Rank numbers on a top list; its few rows are all the single window task sees."""
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "*").orderBy("rank")


def sales_breakdown(
    orders: DataFrame,
    dimension: str,
    start_date: date | str | None = None,
    end_date: date | str | None = None,
) -> DataFrame:
    """Revenue and orders per month, country, category, payment method or zone.

    Months come in order, other dimensions by revenue. Orders without a value in
    the dimension are left out.
    """
    if dimension not in DIMENSIONS:
        raise ValueError(f"invalid dimension, use one of: {', '.join(DIMENSIONS)}")
    sold = non_cancelled(in_period(orders, start_date, end_date))
    by_month = dimension == "month"
    key = F.trunc("order_date", "month") if by_month else F.col(dimension)
    grouped = (
        sold.groupBy(key.alias(dimension))
        .agg(total_of("total").alias("revenue"), F.count("order_id").alias("orders"))
        .where(F.col(dimension).isNotNull())
    )
    if by_month:
        return grouped.withColumn("month", month_label("month")).orderBy("month")
    return grouped.orderBy(F.desc("revenue"), dimension)
