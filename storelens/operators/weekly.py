"""Weekly report tables, for all closed weeks at once; one week is a filter."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import (
    change_pct,
    col,
    lookup,
    money_text,
    not_cancelled,
    percent_text,
    ratio,
    ratio_or_zero,
    run_length,
    status_is,
)
from storelens.functions.dates import fill_calendar, last_closed_sunday, week_end
from storelens.lookups import (
    CANCEL_RATE_LIMIT,
    CONCENTRATION_SHARE,
    FLAT_BELOW,
    PROCESSING_DAYS_LIMIT,
    RETURN_RATE_LIMIT,
    TRANSIT_DAYS_LIMIT,
    TREND_WEEKS,
)
from storelens.operators.ledger import ledger_up_to, weekly_ledger
from storelens.operators.sales import as_date, in_period
from storelens.operators.week_facts import breakdown, week_facts

TREND_METRICS = ("revenue", "orders", "aov", "cancel_rate", "return_rate_filed", "avg_delivery_days")
LOWER_IS_BETTER = ("cancel_rate", "return_rate_filed", "avg_delivery_days")


# ---- calendar -------------------------------------------------------------------


def last_closed_week(orders: DataFrame) -> DataFrame:
    """One row: the last Sunday on or before the latest order."""
    return orders.agg(last_closed_sunday(F.max("order_date")).alias("week_end"))


def snap_to_week(day: Column | str, last_closed: Column) -> Column:
    """The Sunday closing a day's week, at most the last closed one."""
    return F.least(week_end(col(day)), last_closed)


# ---- headline metrics -----------------------------------------------------------


def _ledger(orders: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The stored ledger where given, else one made of the orders."""
    return weekly_ledger(orders) if ledger is None else ledger


def _metrics(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "*",
        ratio_or_zero("revenue", "orders").alias("aov"),
        (100 * ratio_or_zero("cancelled", "placed")).alias("cancel_rate"),
        (100 * ratio_or_zero("filed", "orders")).alias("return_rate_filed"),
        ratio("delivery_days_sum", "delivery_days_known").alias("avg_delivery_days"),
        ratio("units", "orders").alias("units_per_order"),
        (100 * ratio_or_zero("instalment_orders", "orders")).alias("instalment_share"),
    )


def _reported(weeks: DataFrame) -> DataFrame:
    """Drop the lead-in weeks that only served as history."""
    return weeks.where(F.col("week_end") >= F.col("first_week"))


def weekly_metrics(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The figures of every closed week. Returns count by request date, whatever the order."""
    return _reported(_metrics(_ledger(orders, ledger))).select(
        "week_start", "week_end", "revenue", "orders", "aov", "placed", "cancelled", "cancelled_value",
        "cancel_rate", "filed", "return_rate_filed", "avg_delivery_days", "units", "units_per_order",
        "instalment_share",
    )


def _with_history(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Each trend metric with its previous week, 4-week mean and 5-week series.

    The mean is of weekly ratios, and missing unless all four weeks have a value. The
    windows have one row per week to order, so one task is enough for them.
    """
    by_week = W.orderBy("week_end")
    before = by_week.rowsBetween(-TREND_WEEKS, -1)
    metrics = _metrics(_ledger(orders, ledger))
    history = metrics.select("*", *[F.col(m).cast("double").alias(f"{m}_now") for m in TREND_METRICS])
    extra = []
    for m in TREND_METRICS:
        now = F.col(f"{m}_now")
        extra += [
            F.lag(now).over(by_week).alias(f"{m}_prev"),
            F.when(F.count(now).over(before) == TREND_WEEKS, F.avg(now).over(before)).alias(f"{m}_avg4"),
            F.array(
                *[F.lag(now, i).over(by_week) for i in range(TREND_WEEKS, 0, -1)], now
            ).alias(f"{m}_series"),
        ]
    return _reported(history.select("*", *extra))


def _per_metric(history: DataFrame, *fields: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per week and trend metric."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{f}").alias(f) for f in fields])
        for m in TREND_METRICS
    ])
    return history.select("week_start", "week_end", *extra, F.inline(rows))


def _movement(change: Column) -> Column:
    """Direction of a change; tiny and unknown ones are flat."""
    return F.when(change.isNull() | (F.abs(change) < FLAT_BELOW), "flat").when(change > 0, "up").otherwise("down")


def _is_good(metric: Column, direction: Column) -> Column:
    better = F.when(metric.isin(*LOWER_IS_BETTER), "down").otherwise("up")
    return F.when(direction != "flat", direction == better)


def weekly_deltas(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Change of each metric against the previous week."""
    rows = _per_metric(_with_history(orders, ledger), "now", "prev")
    moved = rows.withColumn("delta_pct", change_pct("now", "prev"))
    moved = moved.withColumn("direction", _movement(F.col("delta_pct")))
    return moved.select(
        "week_end", "metric", F.col("now").alias("value"), F.col("prev").alias("previous"), "delta_pct",
        "direction", _is_good(F.col("metric"), F.col("direction")).alias("good"),
    )


def weekly_vs_avg4(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Change of each metric against the mean of the four weeks before."""
    rows = _per_metric(_with_history(orders, ledger), "now", "avg4")
    moved = rows.withColumn("delta_pct", change_pct("now", "avg4"))
    moved = moved.withColumn("direction", _movement(F.col("delta_pct")))
    return moved.select(
        "week_end", "metric", F.col("now").alias("value"), "avg4", "delta_pct", "direction",
        _is_good(F.col("metric"), F.col("direction")).alias("good"),
    )


def weekly_series(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Five values per metric, the four weeks before and the week itself."""
    return _per_metric(_with_history(orders, ledger), "series").select("week_end", "metric", "series")


def decline_streak(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Weekly revenue declines in a row: up to this week, and up to the week before.

    `rebound` marks the first increase after a decline.
    """
    points = _per_metric(_with_history(orders, ledger), "series").where(F.col("metric") == "revenue")
    at = [F.col("series")[i] for i in range(TREND_WEEKS, -1, -1)]
    fell = [now < before for now, before in zip(at, at[1:])]
    return points.select(
        "week_end",
        run_length(fell).alias("streak"),
        run_length(fell[1:]).alias("previous_streak"),
        ((change_pct(at[0], at[1]) > 0) & fell[1]).alias("rebound"),
    )


def report_summary(orders: DataFrame, week_ending: date | str | None = None) -> DataFrame:
    """The headline metrics of one closed week, the last one unless a day is given.

    Any day snaps to the Sunday closing its week, at most the last closed one. A week
    before the first order has zeros, and no delivery time. The latest order date comes
    first; it bounds what is then read to orders placed or returned in five weeks.
    """
    closed = orders.agg(last_closed_sunday(F.max("order_date")).alias("closed")).scalar()
    day = as_date(week_ending)
    picked = closed if day is None else snap_to_week(F.lit(day), closed)
    return weekly_summary(orders, ledger_up_to(orders, picked))


def weekly_summary(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Headline metrics of every closed week with the inputs of their formulas."""
    history = _with_history(orders, ledger)
    rows = _per_metric(
        history, "now", "prev", "avg4",
        extra=("revenue", "orders", "placed", "cancelled", "filed", "delivery_days_sum", "delivery_days_known"),
    )
    metric = F.col("metric")

    def per_metric(**values: str) -> Column:
        out = F.lit(None)
        for name, value in values.items():
            out = F.when(metric == name, F.col(value).cast("double")).otherwise(out)
        return out

    formulas = {
        "revenue": "sum of total of non-cancelled orders placed in the week",
        "orders": "count of non-cancelled orders placed in the week",
        "aov": "revenue / orders",
        "cancel_rate": "cancelled / all orders placed in the week * 100",
        "return_rate_filed": "return requests filed in the week, any order / orders * 100",
        "avg_delivery_days": "mean delivery days of delivered orders placed in the week",
    }
    return rows.select(
        "week_start",
        "week_end",
        "metric",
        F.col("now").alias("value"),
        per_metric(
            aov="revenue", cancel_rate="cancelled", return_rate_filed="filed", avg_delivery_days="delivery_days_sum"
        ).alias("numerator"),
        per_metric(
            aov="orders", cancel_rate="placed", return_rate_filed="orders", avg_delivery_days="delivery_days_known"
        ).alias("denominator"),
        F.col("prev").alias("previous"),
        change_pct("now", "prev").alias("vs_previous_pct"),
        F.col("avg4").alias("average_4_weeks"),
        change_pct("now", "avg4").alias("vs_average_pct"),
        lookup("metric", formulas).alias("formula"),
    )


def summary_text(summary: DataFrame) -> DataFrame:
    """The value of each headline metric as the report prints it, a missing one as NULL."""
    metric, value = F.col("metric"), F.col("value")
    text = (
        F.when(metric == "revenue", money_text(value))
        .when(metric == "orders", F.format_number(value, 0))
        .when(metric == "aov", money_text(value, 2))
        .when(metric == "avg_delivery_days", F.concat(F.format_number(value, 1), F.lit(" days")))
        .otherwise(percent_text(value))
    )
    return summary.select("week_end", "metric", text.alias("text"))


# ---- cancellations, returns, products -------------------------------------------
#
# Each of these reads the orders, or facts of them that a report has stored.


def cancellations_by_country(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Cancelled orders and their value per week and country."""
    return (
        breakdown(orders, facts, "cancelled_country")
        .where(F.col("key").isNotNull())
        .select(
            "week_end",
            F.col("key").alias("country"),
            F.col("order_ids").alias("cancelled"),
            F.col("amount").alias("cancelled_value"),
        )
    )


def cancellation_concentration(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Per week the country with most cancellations, flagged at half of them or more."""
    week = W.partitionBy("week_end")
    ranked = (
        breakdown(orders, facts, "cancelled_country")
        .withColumn("week_cancelled", F.sum("rows").over(week))
        .where(F.col("key").isNotNull())
        .withColumn("place", F.row_number().over(week.orderBy(F.desc("order_ids"), "key")))
        .where(F.col("place") == 1)
    )
    share = ratio("order_ids", F.greatest("week_cancelled", F.lit(1)))
    return ranked.select(
        "week_end",
        F.col("key").alias("country"),
        F.col("order_ids").alias("cancelled"),
        "week_cancelled",
        share.alias("share"),
        (share >= CONCENTRATION_SHARE).alias("concentrated"),
    )


def cancellations_rollup(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Cancellations per week and country plus one total row per week (`country` NULL).

    The rollup expands the few pre-aggregated rows, not the orders.
    """
    rolled = (
        breakdown(orders, facts, "cancelled_country")
        .withColumnRenamed("key", "country")
        .groupingSets([["week_end", "country"], ["week_end"]], "week_end", "country")
        .agg(
            F.grouping("country").alias("is_total"),
            F.sum("rows").alias("cancelled"),
            F.sum("amount").alias("cancelled_value"),
        )
    )
    return rolled.where((F.col("is_total") == 1) | F.col("country").isNotNull()).select(
        "week_end", "country", (F.col("is_total") == 1).alias("is_total"), "cancelled", "cancelled_value"
    )


def _requests(orders: DataFrame, facts: DataFrame | None, name: str, column: str) -> DataFrame:
    return (
        breakdown(orders, facts, name)
        .where(F.col("key").isNotNull())
        .select("week_end", F.col("key").alias(column), F.col("rows").alias("requests"))
    )


def return_buckets(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Return requests per week and bucket; unmapped and missing reasons are `Other`."""
    return _requests(orders, facts, "return_bucket", "bucket")


def returns_controllable(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Per week: requests filed, those not the customer's own choice, value at risk."""
    return _reported(_ledger(orders, ledger)).select(
        "week_end", "filed", F.col("filed_controllable").alias("controllable"), F.col("filed_value").alias("value_at_risk")
    )


def weekly_return_reasons(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Return requests per week and reason."""
    return _requests(orders, facts, "return_reason", "return_reason")


def weekly_return_status(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Return requests per week and resolution status."""
    return _requests(orders, facts, "return_status", "return_status")


def _place_by_revenue() -> Column:
    return F.row_number().over(W.partitionBy("week_end").orderBy(F.desc("amount"), "key"))


def weekly_top_products(orders: DataFrame, facts: DataFrame | None = None, n: int = 5) -> DataFrame:
    """The n products with most revenue of each week.

    Sums are reduced before the shuffle, and the rank limit drops all but n
    candidates per week and task before the rank itself is computed.
    """
    return (
        breakdown(orders, facts, "product")
        .where(F.col("key").isNotNull())
        .withColumn("rank", _place_by_revenue())
        .where(F.col("rank") <= n)
        .select("week_end", "rank", F.col("key").alias("product"), F.col("amount").alias("revenue"))
    )


def repeat_return_products(
    orders: DataFrame, facts: DataFrame | None = None, at_least: int = 2, n: int = 5
) -> DataFrame:
    """Best sellers of a week that were returned more than once in it.

    Sales and returns of a product meet in one grouping, so the orders are read once
    and nothing is joined.
    """
    if facts is None:
        facts = week_facts(orders, ["product", "returned_product"])
    sold = F.col("breakdown") == "product"
    returned = F.col("breakdown") == "returned_product"
    return (
        facts.where((sold | returned) & F.col("key").isNotNull())
        .groupBy("week_end", "key")
        .agg(
            F.sum(F.when(sold, F.col("amount"))).alias("amount"),
            F.sum(F.when(returned, F.col("rows"))).alias("requests"),
        )
        .where(F.col("amount").isNotNull())
        .withColumn("rank", _place_by_revenue())
        .where((F.col("rank") <= n) & (F.col("requests") >= at_least))
        .select("week_end", F.col("key").alias("product"), "requests")
    )


# ---- sales detail ---------------------------------------------------------------


def daily_sales_vs_previous(orders: DataFrame, sunday: date | None = None) -> DataFrame:
    """Revenue of every day of the closed weeks beside the same day a week earlier.

    A day without sales is 0. For the week ending on `sunday` only two weeks of orders
    are read and joined to a calendar of literal dates. For all weeks the calendar is
    filled in over the daily sums, of which there is one per day, so the orders are
    read once.
    """
    if sunday is not None:
        orders = in_period(orders, sunday - timedelta(days=13), sunday)
    daily = (
        orders.where(F.col("order_date").isNotNull())
        .groupBy(F.col("order_date").alias("day"))
        .agg(F.sum(F.when(not_cancelled(), F.col("total"))).alias("revenue"))
    )
    if sunday is not None:
        days = F.sequence(F.lit(sunday - timedelta(days=13)), F.lit(sunday))
        dense = orders.sparkSession.range(1).select(F.explode(days).alias("day")).join(daily, "day", "left")
    else:
        whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        closed = daily.select(
            "*",
            F.date_sub(week_end(F.min("day").over(whole)), 6).alias("first_day"),
            last_closed_sunday(F.max("day").over(whole)).alias("last_day"),
        ).where(F.col("day") <= F.col("last_day"))
        dense = fill_calendar(closed, "day", 1, first=F.col("first_day"), last=F.col("last_day"))
    by_day = dense.select("day", F.coalesce("revenue", F.lit(0).cast("decimal(28,2)")).alias("revenue"))
    compared = by_day.select(
        week_end("day").alias("week_end"),
        "day",
        F.date_format("day", "EEE dd").alias("label"),
        "revenue",
        F.lag("revenue", 7, 0).over(W.orderBy("day")).alias("previous_revenue"),
    )
    return compared if sunday is None else compared.where(F.col("week_end") == F.lit(sunday))


def _weekly_share(orders: DataFrame, facts: DataFrame | None, key: str, measure: str, name: str) -> DataFrame:
    """A weekly measure per value of `key` with its share of the whole week.

    Orders without a value count in the week but get no row.
    """
    return (
        breakdown(orders, facts, key)
        .withColumn("_week", F.sum(measure).over(W.partitionBy("week_end")))
        .where(F.col("key").isNotNull())
        .select(
            "week_end",
            F.col("key").alias(key),
            F.col(measure).alias(name),
            (100 * ratio(measure, "_week")).alias("share_pct"),
        )
    )


def weekly_category_share(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Revenue per week and category with its share of the week."""
    return _weekly_share(orders, facts, "category", "amount", "revenue")


def weekly_country_share(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Revenue per week and country with its share of the week."""
    return _weekly_share(orders, facts, "country", "amount", "revenue")


def weekly_payment_share(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Orders per week and payment method with their share of the week."""
    return _weekly_share(orders, facts, "payment_method", "rows", "orders")


def _weekly_table(orders: DataFrame, facts: DataFrame | None, key: str, measure: str, name: str) -> DataFrame:
    """Rows per week and key with their share, and a total row per week that counts missing keys too.

    The rollup expands the few pre-aggregated rows, not the orders.
    """
    rolled = (
        breakdown(orders, facts, key)
        .withColumnRenamed("key", key)
        .groupingSets([["week_end", key], ["week_end"]], "week_end", key)
        .agg((F.grouping(key) == 1).alias("is_total"), F.sum(measure).alias(name))
    )
    total = F.max(F.when(F.col("is_total"), F.col(name))).over(W.partitionBy("week_end"))
    return (
        rolled.withColumn("share_pct", 100 * ratio(name, total))
        .where(F.col("is_total") | F.col(key).isNotNull())
        .select("week_end", key, "is_total", name, "share_pct")
    )


def weekly_country_table(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Revenue per week and country, with a total per week."""
    return _weekly_table(orders, facts, "country", "amount", "revenue")


def weekly_payment_table(orders: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Orders per week and payment method, with a total per week."""
    return _weekly_table(orders, facts, "payment_method", "rows", "orders")


# ---- backlog and alerts ---------------------------------------------------------


def backlog(
    orders: DataFrame,
    cutoff: date | str | None = None,
    transit_days: int = TRANSIT_DAYS_LIMIT,
    processing_days: int = PROCESSING_DAYS_LIMIT,
) -> DataFrame:
    """One row: orders under way and in processing at a cutoff, and those overdue.

    The cutoff is the last closed Sunday unless given; its row comes out of the
    ledger, so the orders need not be read for their latest date first.
    """
    day = as_date(cutoff)
    if day is None:
        ledger = weekly_ledger(orders, transit_days=transit_days, processing_days=processing_days)
        return weekly_backlog(orders, ledger).orderBy(F.desc("cutoff")).limit(1)
    in_transit = F.col("order_status").isin("shipped", "in_transit")
    processing = status_is("processing")
    age = F.date_diff(F.lit(day), "order_date")
    return (
        orders.where((in_transit | processing) & (F.col("order_date") <= F.lit(day)))
        .agg(
            F.count_if(in_transit).alias("open_orders"),
            F.count_if(in_transit & (age > transit_days)).alias("open_aged"),
            F.coalesce(F.max(F.when(in_transit, age)), F.lit(0)).alias("oldest_open_days"),
            F.count_if(processing).alias("processing_orders"),
            F.count_if(processing & (age > processing_days)).alias("processing_aged"),
        )
        .select(F.lit(day).alias("cutoff"), "*")
    )


def weekly_backlog(orders: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The backlog at the end of every closed week, out of running sums."""
    return _reported(_ledger(orders, ledger)).select(
        F.col("week_end").alias("cutoff"),
        "open_orders", "open_aged", "oldest_open_days", "processing_orders", "processing_aged",
    )


def weekly_alerts(
    orders: DataFrame,
    ledger: DataFrame | None = None,
    cancel_rate_limit: float = CANCEL_RATE_LIMIT,
    return_rate_limit: float = RETURN_RATE_LIMIT,
) -> DataFrame:
    """Alerts per week: the two rates always, fired or not; overdue orders only if any.

    `cases` of `out_of` tell the count behind the value. What counts as overdue is
    settled when the ledger is made.
    """
    weeks = _reported(_metrics(_ledger(orders, ledger)))

    def alert(name: str, value: str, limit: float, cases: str, out_of: str) -> Column:
        v = F.col(value).cast("double")
        return F.struct(
            F.lit(name).alias("alert"),
            v.alias("value"),
            F.lit(float(limit)).alias("threshold"),
            (v > limit).alias("fired"),
            F.col(cases).cast("bigint").alias("cases"),
            F.col(out_of).cast("bigint").alias("out_of"),
        )

    alerts = F.array(
        alert("cancellations", "cancel_rate", cancel_rate_limit, "cancelled", "placed"),
        alert("returns", "return_rate_filed", return_rate_limit, "filed_controllable", "filed"),
        alert("transit_overdue", "open_aged", 0, "open_aged", "open_orders"),
        alert("processing_overdue", "processing_aged", 0, "processing_aged", "processing_orders"),
    )
    return weeks.select("week_end", F.inline(alerts)).where(
        F.col("alert").isin("cancellations", "returns") | F.col("fired")
    )
