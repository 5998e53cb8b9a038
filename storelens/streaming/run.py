"""Running a streaming job over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storelens.sources.logs import path_exists
from storelens.sources.published import publish, published_folders
from storelens.sources.scratch import scratch_folder

# Batches of changes after which the table is written as a whole again.
FOLD_AFTER = 50


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Process all available input and return the result, read back from Parquet.

    Append mode writes through the file sink, which counts every row once across
    restarts. Update mode adds each batch's changed rows, by `keys`; complete mode
    publishes each batch's full result. In both a reader sees the table of the last batch
    that was noted, and a batch that runs again after a failure counts once.
    """
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark)
    target = f"{folder}/result"
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
    )
    if mode == "append":
        query = writer.format("parquet").start(target)
    else:
        query = writer.foreachBatch(changes_into(target, keys, whole=mode == "complete")).start()
    query.awaitTermination()
    if mode != "append":
        return read_changes(spark, target, stream.schema, keys)
    if not path_exists(spark, target):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(target)


def changes_into(target: str, keys: Sequence[str], whole: bool = False, fold_after: int = FOLD_AFTER) -> Callable[[DataFrame, int], None]:
    """What a stream does with a batch of changed rows: publish it under its number.

    Every `fold_after` batches the table so far is published as a whole, so that readers
    never have more than these many folders to merge.
    """
    if not whole and not keys:
        raise ValueError("changed rows need keys")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def write(folder: str) -> None:
            rows = batch
            if fold:
                before = read_changes(spark, target, batch.schema, keys)
                rows = before.join(batch.select(*keys), list(keys), "left_anti").select(*batch.columns).unionByName(batch)
            rows.write.parquet(folder)

        fold = not whole and number % fold_after == fold_after - 1
        publish(spark, target, write, number, whole or fold)

    return put


def read_changes(spark: SparkSession, target: str, schema: StructType, keys: Sequence[str] = ()) -> DataFrame:
    """The table that the noted batches make: per key the row of the latest batch."""
    folders = published_folders(spark, target)
    if not folders:
        return spark.createDataFrame([], schema)
    read = [spark.read.schema(schema).parquet(path).withColumn("_batch", F.lit(n)) for n, path in folders]
    if len(read) == 1:
        return read[0].drop("_batch")
    rows = reduce(DataFrame.unionByName, read)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "_batch").alias("row"))
    return latest.select("row.*")
