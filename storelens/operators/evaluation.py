"""Evaluation runs: judge replies to verdicts, verdicts to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import col, ratio, strip
from storelens.lookups import ERROR_CHARS, JUDGE_ERROR, JUDGE_VERDICTS, REPLY_CHARS, UNREAD_REPLY, VERDICTS


def parsed_reply(reply: Column | str) -> Column:
    """Struct of verdict and reason in a judge's reply; unusable ones need review.

    A reply that is no JSON object, alone and in double quotes, is the judge's error; an
    object without a known verdict is unparseable. Either reason shows how the text starts.
    """
    bare = F.regexp_replace(strip(reply), r"^(?:```json)?(?:```)?|```\z", "")
    text = strip(bare)
    # As the only element of a list: text after the object makes it unreadable.
    listed = F.when(
        text.startswith("{") & text.endswith("}"),
        F.from_json(
            F.concat(F.lit("["), text, F.lit("]")), "array<struct<verdict string, reason string>>",
            {"allowSingleQuotes": "false"},
        ),
    )
    data = F.when(F.size(listed) == 1, listed[0])
    usable = F.coalesce(data["verdict"].isin(*JUDGE_VERDICTS), F.lit(False))
    start = F.left(F.coalesce(text, F.lit("")), F.lit(REPLY_CHARS))
    unread = F.concat(F.when(data.isNull(), JUDGE_ERROR).otherwise(UNREAD_REPLY), start)
    return F.struct(
        F.when(usable, data["verdict"]).otherwise("NEEDS_REVIEW").alias("verdict"),
        F.when(usable, data["reason"]).otherwise(unread).alias("reason"),
    )


def parse_verdicts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replace the reply column by verdict and reason."""
    others = [c for c in replies.columns if c != reply]
    return replies.select(*others, parsed_reply(col(reply)).alias("_v")).select(*others, "_v.*")


def verdict_table(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Gold questions with the answer they got, its seconds, verdict and reason.

    `answers` holds `id, answer, elapsed_s, error, reply`, the reply being the judge's.
    An answer that failed is an `ERROR` with the start of its error text.
    """
    failed = F.coalesce("error", F.lit("")) != ""
    judged = parsed_reply("reply")
    scored = answers.select(
        "id",
        F.when(failed, F.lit("")).otherwise(F.col("answer")).alias("answer"),
        F.round("elapsed_s", 1).alias("elapsed_s"),
        F.when(failed, F.lit("ERROR")).otherwise(judged["verdict"]).alias("verdict"),
        F.when(failed, F.left("error", F.lit(ERROR_CHARS))).otherwise(judged["reason"]).alias("reason"),
    )
    return gold.join(scored, "id")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Rows per verdict and their share of all rows; a verdict nobody got shows 0."""
    counted = verdicts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
    )
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("answers")) for v in VERDICTS])
    return counted.select("total", F.inline(rows)).select(
        "verdict", "answers", ratio("answers", "total").alias("share")
    )


def pass_by_category(verdicts: DataFrame) -> DataFrame:
    """Passed and all answers per category."""
    return (
        verdicts.groupBy("category")
        .agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count(F.lit(1)).alias("answers"))
        .orderBy("category")
    )
