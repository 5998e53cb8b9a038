"""Independent audit of the weekly figures.

Written in SQL on purpose, from the orders up: it shares no expression with the
tables it checks, so a wrong formula would have to be made twice in the same way.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.lookups import AUDIT_TOLERANCE

_WEEKLY = """
    SELECT week_end, metric, SUM(amount) AS audit_value
    FROM (
        SELECT stack(4, placed, 'revenue', sale, placed, 'orders', kept, placed, 'cancelled', dropped,
                     filed, 'filed', one) AS (week_end, metric, amount)
        FROM (SELECT CAST(date_trunc('WEEK', order_date) AS DATE) + INTERVAL 6 DAYS AS placed,
                     CAST(date_trunc('WEEK', return_request_date) AS DATE) + INTERVAL 6 DAYS AS filed,
                     CAST(IF(COALESCE(order_status, '') = 'cancelled', 0, COALESCE(total, 0)) AS DECIMAL(18, 2)) AS sale,
                     CAST(IF(COALESCE(order_status, '') = 'cancelled', 0, 1) AS DECIMAL(18, 2)) AS kept,
                     CAST(IF(COALESCE(order_status, '') = 'cancelled', 1, 0) AS DECIMAL(18, 2)) AS dropped,
                     CAST(1 AS DECIMAL(18, 2)) AS one
              FROM {orders})
    )
    WHERE week_end BETWEEN (SELECT CAST(date_trunc('WEEK', MIN(order_date)) AS DATE) FROM {orders})
                       AND (SELECT MAX(order_date) - (weekday(MAX(order_date)) + 1) % 7 FROM {orders})
    GROUP BY week_end, metric
"""

_ONE_WEEK = """
    SELECT :sunday AS week_end, metric, CAST(audit_value AS DECIMAL(28, 2)) AS audit_value
    FROM (
        SELECT stack(4, 'revenue', revenue, 'orders', orders, 'cancelled', cancelled, 'filed', filed)
               AS (metric, audit_value)
        FROM (
            SELECT CAST(COALESCE(SUM(total) FILTER (WHERE placed AND order_status IS DISTINCT FROM 'cancelled'), 0)
                        AS DECIMAL(28, 2)) AS revenue,
                   CAST(COUNT(*) FILTER (WHERE placed AND order_status IS DISTINCT FROM 'cancelled')
                        AS DECIMAL(28, 2)) AS orders,
                   CAST(COUNT(*) FILTER (WHERE placed AND order_status = 'cancelled') AS DECIMAL(28, 2)) AS cancelled,
                   CAST(COUNT(*) FILTER (WHERE return_request_date BETWEEN :monday AND :sunday)
                        AS DECIMAL(28, 2)) AS filed
            FROM (SELECT *, order_date BETWEEN :monday AND :sunday AS placed
                  FROM {orders}
                  WHERE order_date BETWEEN :monday AND :sunday
                     OR return_request_date BETWEEN :monday AND :sunday)
        )
    )
"""


def report_figures(metrics: DataFrame) -> DataFrame:
    """The audited figures of a weekly metrics table, one per row."""
    names = ("revenue", "orders", "cancelled", "filed")
    figures = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("decimal(28,2)").alias("report_value")) for n in names]
    return metrics.select("week_end", F.inline(F.array(*figures)))


def audit_report(
    orders: DataFrame, metrics: DataFrame, week_end: date | None = None, tolerance: float = AUDIT_TOLERANCE
) -> DataFrame:
    """Report figures beside figures recomputed from the orders, flagged if they match.

    All closed weeks, or one when `week_end` (a Sunday) is given. A figure only one
    side knows counts as 0 on the other.
    """
    spark = orders.sparkSession
    if week_end is None:
        recomputed = spark.sql(_WEEKLY, orders=orders)
    else:
        metrics = metrics.where(F.col("week_end") == F.lit(week_end))
        week = {"monday": week_end - timedelta(days=6), "sunday": week_end}
        recomputed = spark.sql(_ONE_WEEK, args=week, orders=orders)
    both = report_figures(metrics).join(recomputed, ["week_end", "metric"], "full")
    zero = F.lit(0).cast("decimal(28,2)")
    return both.select(
        "week_end",
        "metric",
        F.coalesce("report_value", zero).alias("report_value"),
        F.coalesce("audit_value", zero).cast("decimal(28,2)").alias("audit_value"),
    ).withColumn("matches", F.abs(F.col("report_value") - F.col("audit_value")) < tolerance)


class AuditError(RuntimeError):
    """A report figure differs from its recomputation."""


def require_match(audit: DataFrame) -> None:
    """Fail unless every audited figure matches; the error counts those that do not and names the first few."""
    wrong = audit.where(~F.col("matches"))
    named = wrong.orderBy("week_end", "metric").limit(10).collect()
    if named:
        raise AuditError(f"{wrong.count()} figures differ: " + "; ".join(
            f"{r['week_end']} {r['metric']}: report {r['report_value']}, audit {r['audit_value']}" for r in named
        ))
