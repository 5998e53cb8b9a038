"""Weeks, months and dense calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import col


def week_end(day: Column | str) -> Column:
    """The Sunday that closes the Mon-Sun week of a day."""
    return F.next_day(F.date_sub(col(day), 1), "SUN")


def last_closed_sunday(day: Column | str) -> Column:
    """The latest Sunday on or before a day."""
    return F.date_sub(col(day), F.dayofweek(col(day)) - 1)


def month_label(day: Column | str) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def fill_calendar(
    rows: DataFrame, key: str, step_days: int, first: Column | None = None, last: Column | None = None
) -> DataFrame:
    """Add a row for every missing date of a regular calendar.

    `rows` is an already aggregated table with one row per `key` date, so it holds
    at most one row per calendar step however large the facts are; that makes the
    single-task window below safe. Each row fills the gap up to the next one, which
    needs no second pass over the facts and no join. `first` and `last` stretch the
    calendar beyond the rows at hand. Columns of an added row are NULL.
    """
    others = [c for c in rows.columns if c != key]
    in_order = W.orderBy(key)
    start = F.col(key)
    if first is not None:
        start = F.when(F.lag(key).over(in_order).isNull(), F.least(first, start)).otherwise(start)
    stop = F.date_sub(F.lead(key).over(in_order), step_days)
    if last is not None:
        stop = F.coalesce(stop, F.greatest(last, F.col(key)))
    spans = rows.select("*", start.alias("_from"), F.coalesce(stop, F.col(key)).alias("_to"))
    step = F.expr(f"interval {int(step_days)} days")
    return spans.select(
        *rows.columns, F.explode(F.sequence("_from", "_to", step)).alias("_date")
    ).select(
        F.col("_date").alias(key),
        *[F.when(F.col("_date") == F.col(key), F.col(c)).alias(c) for c in others],
    )


def whole_range(low: Column, high: Column, alias: str, block: int = 65536) -> tuple[Column, Column]:
    """Two generators that list the integers low..high block by block.

    Apply the first in one select and the second in the next: no row ever holds
    more than `block` numbers, even when a mistyped value makes the range huge.
    """
    blocks = F.explode(F.sequence(F.floor(low / block), F.floor(high / block))).alias("_block")
    start = F.greatest(low, F.col("_block") * block)
    stop = F.least(high, F.col("_block") * block + (block - 1))
    return blocks, F.explode(F.sequence(start, stop)).alias(alias)
