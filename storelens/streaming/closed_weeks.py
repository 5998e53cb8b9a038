"""Weekly order figures that appear once their week is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.columns import not_cancelled, status_is

# 1970-01-01 was a Thursday: four days on, windows of seven days start on Mondays.
MONDAY_OFFSET = "4 days"


def closed_weeks(orders: DataFrame, time: str = "order_ts", lateness: str = "1 day") -> DataFrame:
    """Order-side figures per Mon-Sun week over a stream of orders.

    In append mode a week comes out once the watermark has passed its end, so a late
    order within `lateness` still counts and a week is never revised. Weeks are cut at
    midnight UTC. `time` may be the date of cleaned orders.
    """
    sold = not_cancelled()
    if isinstance(orders.schema[time].dataType, T.DateType):
        orders = orders.withColumn(time, F.timestamp_seconds(F.unix_date(time) * 86400))
    return (
        orders.withWatermark(time, lateness)
        .groupBy(F.window(time, "7 days", startTime=MONDAY_OFFSET))
        .agg(
            F.coalesce(F.sum(F.when(sold, F.col("total"))), F.lit(0).cast("decimal(28,2)")).alias("revenue"),
            F.count_if(sold).alias("orders"),
            F.count(F.lit(1)).alias("placed"),
            F.count_if(status_is("cancelled")).alias("cancelled"),
            F.coalesce(F.sum(F.when(sold, F.col("quantity"))), F.lit(0)).alias("units"),
        )
        .select(
            F.date_from_unix_date(F.expr("cast(unix_seconds(window.end) div 86400 as int)") - 1).alias("week_end"),
            "revenue",
            "orders",
            "placed",
            "cancelled",
            "units",
        )
    )
