"""Interaction log, agent runs, trace archive and evaluation files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.columns import col
from storelens.lookups import ARCHIVE_CHARS, ARCHIVE_DAYS
from storelens.schema import GOLD_QUESTIONS, INTERACTIONS


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """The JSON-lines interaction log, empty if it does not exist yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], INTERACTIONS)
    return spark.read.schema(INTERACTIONS).json(path)


def stream_interactions(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The interaction log as a stream of the JSON-lines files that arrive at `path`."""
    reader = spark.readStream.schema(INTERACTIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def append_interactions(interactions: DataFrame, path: str) -> None:
    """Append a batch to the log: whole-second UTC times, latency to two decimals."""
    utc = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    interactions.select(
        utc.alias("ts"),
        "question",
        F.coalesce("tools", F.array().cast("array<string>")).alias("tools"),
        F.round("latency_s", 2).alias("latency_s"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
    ).write.mode("append").json(path)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds, NULL if either time is missing."""
    micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return micros / F.lit(1e6)


def in_trailing_days(ts: Column | str, days: int | None, as_of: Column) -> Column:
    if days is None:
        return F.lit(True)
    return col(ts) >= as_of - F.make_dt_interval(F.lit(int(days)))


def trace_archive(runs: DataFrame, days: int = ARCHIVE_DAYS, as_of: Column | None = None) -> DataFrame:
    """Root runs of the last days with latency and the start of input and output.

    `as_of` is a timestamp expression; the latest start in the table by default.
    """
    if as_of is None:
        as_of = runs.agg(F.max("start_time")).scalar()
    return runs.where(F.col("is_root") & in_trailing_days("start_time", days, as_of)).select(
        "id",
        "name",
        "start_time",
        seconds_between("start_time", "end_time").alias("latency_s"),
        "total_tokens",
        "error",
        F.substring("inputs", 1, ARCHIVE_CHARS).alias("input"),
        F.substring("outputs", 1, ARCHIVE_CHARS).alias("output"),
    )


def write_trace_archive(archive: DataFrame, path: str, export_date: str) -> None:
    """Add one export to the archive; repeating a day replaces that day only."""
    (
        archive.withColumn("export_date", F.lit(export_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("export_date")
        .json(path)
    )


def read_gold_questions(spark: SparkSession, path: str) -> DataFrame:
    nested = spark.read.schema(GOLD_QUESTIONS).option("multiLine", True).json(path)
    return nested.select(F.explode("questions").alias("q")).select("q.*")


def write_verdicts(verdicts: DataFrame, path: str, run_id: str) -> None:
    """Store the verdict table of one evaluation run beside the earlier runs."""
    (
        verdicts.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )
