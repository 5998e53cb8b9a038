"""Topic counts over the growing interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.lookups import TOOL_TOPICS
from storelens.operators.team import tool_topic


def topic_windows(
    interactions: DataFrame,
    topics: dict[str, str] = TOOL_TOPICS,
    length: str = "7 days",
    slide: str = "1 day",
    lateness: str = "1 day",
) -> DataFrame:
    """Tool calls per topic in sliding windows, for a streamed or a stored log.

    The watermark bounds the state: a window is dropped once it ended `lateness`
    before the latest event. `tools` is an array of tool names.
    """
    calls = interactions.withWatermark("ts", lateness).select(
        "ts", F.explode("tools").alias("tool")
    ).select("ts", tool_topic("tool", topics).alias("topic"))
    return (
        calls.groupBy(F.window("ts", length, slide), "topic")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "topic",
            "calls",
        )
    )
