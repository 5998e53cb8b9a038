"""Chart series and their one-row summaries. All leave cancelled orders out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import blank_to_null, localized, ratio, total_of, whole_number
from storelens.functions.dates import month_label, whole_range
from storelens.lookups import CHART_KINDS, CHART_PRODUCTS_MAX, CHART_PRODUCTS_MIN, LABELS_ES
from storelens.operators.sales import count_by, counts_of, in_period, non_cancelled


def _labels(lang: str) -> dict[str, str]:
    return LABELS_ES if lang == "es" else {}


def _label(key: str, lang: str) -> Column:
    return localized(key, _labels(lang)).alias("label")


# ---- series ---------------------------------------------------------------------


def monthly_sales(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    return (
        sold.where(F.col("order_date").isNotNull())
        .groupBy(F.trunc("order_date", "month").alias("month"))
        .agg(total_of("total").alias("revenue"))
        .select(month_label("month").alias("month"), "revenue")
        .orderBy("month")
    )


def top_products(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    """The n best products, 3 to 15 of them, ascending as bars are drawn upwards."""
    best = (
        sold.where(F.col("product").isNotNull())
        .groupBy("product")
        .agg(total_of("total").alias("revenue"))
        .orderBy(F.desc("revenue"), "product")
        .limit(max(CHART_PRODUCTS_MIN, min(n, CHART_PRODUCTS_MAX)))
    )
    return best.orderBy("revenue", F.desc("product"))


def returns_by_reason(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    counts = count_by(
        sold.withColumn("return_reason", blank_to_null("return_reason")), "return_reason", "requests"
    )
    return counts.select("return_reason", _label("return_reason", lang), "requests")


def payment_share(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    """Orders per payment method with their share of all orders that have one."""
    counts = counts_of(sold, "payment_method", "orders")
    # One row per payment method is all the unpartitioned window sees.
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shares = counts.withColumn("share", ratio("orders", F.sum("orders").over(whole)))
    return shares.select("payment_method", _label("payment_method", lang), "orders", "share").orderBy(
        F.desc("orders"), "payment_method"
    )


def _delivery_days(sold: DataFrame) -> DataFrame:
    return sold.select(whole_number("delivery_days").alias("days")).where(F.col("days").isNotNull())


def delivery_days_hist(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    """Orders per delivery day, from the shortest to the longest, empty days as 0.

    The gaps are filled from each bin up to the next one, so neither a second read
    nor a join is needed.
    """
    counts = _delivery_days(sold).groupBy("days").agg(F.count(F.lit(1)).alias("orders"))
    # One row per distinct whole day reaches the single window task.
    after = F.lead("days").over(W.orderBy("days"))
    spans = counts.withColumn("stop", F.coalesce(after - 1, F.col("days")))
    blocks, days = whole_range(F.col("days").cast("bigint"), F.col("stop").cast("bigint"), "day")
    return (
        spans.select("*", blocks)
        .select("days", "orders", days)
        .select(
            F.col("day").cast("int").alias("days"),
            F.when(F.col("day") == F.col("days"), F.col("orders")).otherwise(F.lit(0)).alias("orders"),
        )
        .orderBy("days")
    )


def _revenue_by(sold: DataFrame, key: str, lang: str) -> DataFrame:
    return (
        sold.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(total_of("total").alias("revenue"))
        .orderBy(F.desc("revenue"), key)
        .select(key, _label(key, lang), "revenue")
    )


def sales_by_country(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    return _revenue_by(sold, "country", lang)


def sales_by_category(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    return _revenue_by(sold, "category", lang)


# ---- summaries ------------------------------------------------------------------


def monthly_peak_low(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    """Months with most and least revenue, the earlier one on equal revenue."""
    months = monthly_sales(sold)
    number = F.replace("month", F.lit("-"), F.lit("")).cast("int")
    ends = months.agg(
        F.max(F.struct("revenue", (-number).alias("earlier"), "month")).alias("peak"),
        F.min(F.struct("revenue", "month")).alias("low"),
    )
    return ends.select(
        F.col("peak.month").alias("peak_month"),
        F.col("peak.revenue").alias("peak_revenue"),
        F.col("low.month").alias("low_month"),
        F.col("low.revenue").alias("low_revenue"),
    )


def delivery_stats(sold: DataFrame, lang: str = "en", n: int = 10) -> DataFrame:
    """Mean and exact median of the delivery days."""
    return _delivery_days(sold).agg(
        F.avg("days").alias("mean_days"), F.median("days").alias("median_days")
    )


_SERIES = {
    "monthly_sales": monthly_sales,
    "sales_by_country": sales_by_country,
    "sales_by_category": sales_by_category,
    "top_products": top_products,
    "returns_by_reason": returns_by_reason,
    "payment_share": payment_share,
    "delivery_days_hist": delivery_days_hist,
}
# The measure a chart's leader has most of, and the key that breaks ties.
_LED_BY = {
    "sales_by_country": ("revenue", "country"),
    "sales_by_category": ("revenue", "category"),
    "top_products": ("revenue", "product"),
    "returns_by_reason": ("requests", "return_reason"),
    "payment_share": ("orders", "payment_method"),
}


def _leader(kind: str) -> Callable[..., DataFrame]:
    measure, key = _LED_BY[kind]
    return lambda sold, lang, n: _SERIES[kind](sold, lang, n).orderBy(F.desc(measure), key).limit(1)


_SUMMARIES = {
    "monthly_sales": monthly_peak_low,
    "delivery_days_hist": delivery_stats,
    **{kind: _leader(kind) for kind in _LED_BY},
}


def _build(builders: dict, orders: DataFrame, kind: str, lang: str, n: int, start_date, end_date) -> DataFrame:
    if kind not in CHART_KINDS:
        raise ValueError(f"invalid kind, use one of: {', '.join(CHART_KINDS)}")
    return builders[kind](non_cancelled(in_period(orders, start_date, end_date)), lang, n)


def chart_series(
    orders: DataFrame,
    kind: str,
    lang: str = "en",
    n: int = 10,
    start_date: date | str | None = None,
    end_date: date | str | None = None,
) -> DataFrame:
    """The points of a chart. `lang` 'es' gives Spanish labels, anything else English."""
    return _build(_SERIES, orders, kind, lang, n, start_date, end_date)


def chart_summary(
    orders: DataFrame,
    kind: str,
    lang: str = "en",
    n: int = 10,
    start_date: date | str | None = None,
    end_date: date | str | None = None,
) -> DataFrame:
    """One row that sums a chart up: peak and low, the leader, or mean and median."""
    return _build(_SUMMARIES, orders, kind, lang, n, start_date, end_date)
