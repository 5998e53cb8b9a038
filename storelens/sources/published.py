"""Tables that readers see as a whole: new files first, then one note that they count."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.logs import path_exists

NOTES = "number long, folder string, whole boolean"


def _notes(spark: SparkSession, path: str) -> DataFrame:
    """One row per publication; a folder counts once its row is there."""
    notes = f"{path}/published"
    return spark.read.schema(NOTES).parquet(notes) if path_exists(spark, notes) else spark.createDataFrame([], NOTES)


def publish(spark: SparkSession, path: str, write: Callable[[str], None], number: int | None = None, whole: bool = True) -> bool:
    """Let `write` fill a new folder under `path`, then note it.

    A run that fails leaves files nobody reads. A `number` that is noted already is not
    written again, so a batch that is repeated counts once; without one the next is taken.
    `whole` publications replace what was before, others add to it.
    """
    noted = _notes(spark, path)
    if number is None:
        number = (noted.agg(F.max("number")).first()[0] or 0) + 1
    elif not noted.where(F.col("number") == number).isEmpty():
        return False
    folder = f"{number}-{uuid.uuid4().hex[:8]}"
    write(f"{path}/{folder}")
    # A single file, which the committer moves into place.
    spark.createDataFrame([(number, folder, whole)], NOTES).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return True


def published_folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The folders that make up the table: the last whole one and those after it, with their numbers.

    The driver holds a short row per publication since the last whole one.
    """
    noted = _notes(spark, path)
    first = noted.where("whole").agg(F.max("number")).first()[0]
    rows = noted.where(F.lit(True) if first is None else F.col("number") >= first).orderBy("number").collect()
    return [(r["number"], f"{path}/{r['folder']}") for r in rows]


def latest_folder(spark: SparkSession, path: str) -> str:
    folders = published_folders(spark, path)
    if not folders:
        raise FileNotFoundError(f"nothing is published under {path}")
    return folders[-1][1]
