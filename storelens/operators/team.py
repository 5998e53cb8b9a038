"""What the team asks: questions, tools and topics out of logs and traces.

The tools of an interaction are held as counted entries, `array<struct<tool,calls>>`.
A tool called a million times in one trace is one entry, so no list grows with the
number of calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import lookup, ratio, strip
from storelens.lookups import INSIGHT_DAYS, OTHER, QUESTION_CHARS, TOOL_TOPICS, TRACE_QUESTION
from storelens.sources.logs import in_trailing_days

TOOL_CALLS = "array<struct<tool:string,calls:bigint>>"


def logged_interactions(log: DataFrame) -> DataFrame:
    """Log rows with counted tools; a row without tools has none."""
    counted = F.transform("tools", lambda t: F.struct(t.alias("tool"), F.lit(1).cast("bigint").alias("calls")))
    return log.select("ts", "question", F.coalesce(counted, F.array()).cast(TOOL_CALLS).alias("tools"))


def _with_tools(roots: DataFrame, runs: DataFrame) -> DataFrame:
    """Add to each root the counted tools of its trace, none if it called none.

    Calls are summed per trace and tool before anything is gathered, partly where
    the runs lie: a trace holding a large part of all runs arrives as one row per
    distinct tool.
    """
    calls = (
        runs.where(F.col("run_type") == "tool")
        .groupBy("trace_id", F.col("name").alias("tool"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    tools = calls.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("tool", "calls"))).alias("tools")
    )
    return roots.join(tools, "trace_id", "left").withColumn(
        "tools", F.coalesce("tools", F.array()).cast(TOOL_CALLS)
    )


def trace_tools(runs: DataFrame) -> DataFrame:
    """Root runs with the tools their trace called."""
    roots = runs.where("is_root").select("trace_id", "id", "name", F.col("start_time").alias("ts"))
    return _with_tools(roots, runs)


def trace_question(inputs: Column | str) -> Column:
    """The question inside a root run's printed inputs, NULL if there is none."""
    found = F.regexp_extract(inputs, TRACE_QUESTION, 1)
    return F.substring(F.nullif(found, F.lit("")), 1, QUESTION_CHARS)


def traced_interactions(runs: DataFrame, days: int | None = INSIGHT_DAYS, as_of: Column | None = None) -> DataFrame:
    """Traced questions of the last days; a run without a readable question is dropped.

    The question is cut out before the join, so the long inputs are never shuffled.
    """
    if days is not None:
        as_of = runs.agg(F.max("start_time")).scalar() if as_of is None else as_of
        runs = runs.where(in_trailing_days("start_time", days, as_of))
    asked = runs.where("is_root").select(
        "trace_id", F.col("start_time").alias("ts"), trace_question("inputs").alias("question")
    )
    return _with_tools(asked.where(F.col("question").isNotNull()), runs).select("ts", "question", "tools")


def all_interactions(
    log: DataFrame, runs: DataFrame, days: int | None = INSIGHT_DAYS, as_of: Column | None = None
) -> DataFrame:
    """Logged and traced interactions, duplicates kept. Only traces have a time bound."""
    return logged_interactions(log).unionByName(traced_interactions(runs, days, as_of))


def team_questions(interactions: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent questions, by exact text."""
    return (
        interactions.where(F.col("question").isNotNull())
        .groupBy("question")
        .agg(F.count(F.lit(1)).alias("times"))
        .orderBy(F.desc("times"), "question")
        .limit(n)
    )


def interaction_count(interactions: DataFrame) -> DataFrame:
    """One row: how many logged and traced interactions the team's figures rest on."""
    return interactions.agg(F.count(F.lit(1)).alias("interactions"))


def tool_topic(tool: Column | str, topics: dict[str, str] = TOOL_TOPICS) -> Column:
    return lookup(tool, topics, OTHER)


def team_topics(interactions: DataFrame, topics: dict[str, str] = TOOL_TOPICS) -> DataFrame:
    """Tool calls per topic with their share of all calls, the leading topic first."""
    calls = interactions.select(F.explode("tools").alias("t")).select("t.tool", "t.calls")
    per_topic = calls.groupBy(tool_topic("tool", topics).alias("topic")).agg(F.sum("calls").alias("calls"))
    # One row per topic of the mapping is all the unpartitioned window sees.
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return per_topic.select(
        "topic", "calls", ratio("calls", F.sum("calls").over(whole)).alias("share")
    ).orderBy(F.desc("calls"), "topic")


def token_usage(messages: DataFrame) -> DataFrame:
    """Tokens per interaction over its messages; a message without usage counts 0."""
    spent = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return (
        messages.groupBy("interaction_id")
        .agg(*spent)
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    )


def content_text(content: Column | str, is_list: Column | None = None) -> Column:
    """Message content as plain text: the texts of a list of blocks are joined, text stays.

    A block is an object with a `text`, or a plain string. Where a list arrives as JSON,
    `is_list` tells it from a text that looks like one; without it, only a JSON list of
    nothing but objects is one.
    """
    content = F.col(content) if isinstance(content, str) else content
    blocks = F.from_json(content, "array<variant>")
    is_object = lambda b: F.startswith(F.schema_of_variant(b), F.lit("OBJECT"))
    texts = F.transform(
        blocks,
        lambda b: F.when(is_object(b), F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
        .otherwise(F.coalesce(b.cast("string"), F.lit(""))),
    )
    only_objects = (F.size(blocks) > 0) & F.forall(blocks, lambda b: F.coalesce(is_object(b), F.lit(False)))
    listed = F.coalesce(only_objects if is_list is None else is_list, F.lit(False))
    return F.when(listed & blocks.isNotNull(), strip(F.array_join(texts, ""))).otherwise(content)
