"""Records of large files, read by many tasks at once.

A file's splits know neither how many records lie before them nor whether they begin
inside a quoted cell. Each split finds out what it would hand on, a row per split is
summed up in file order, and the splits then know. Both steps read the same shuffle of
the lines, by split, so a file is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

_SPLIT = ("file", "split")


def _in_order() -> WindowSpec:
    return W.partitionBy(*_SPLIT).orderBy("nth")


def _earlier_splits() -> WindowSpec:
    return W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)


def lines_by_split(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Lines that `end` closes, with file, split and place: (file, file_name, split, nth, line).

    `split` is where a split starts in its file; `nth` rises along a split's lines.
    """
    read = spark.read.option("lineSep", end).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"),
        F.coalesce("_metadata.file_block_start", F.lit(0)).alias("split"),
        F.monotonically_increasing_id().alias("nth"), F.coalesce("value", F.lit("")).alias("line"),
    ).repartition(*_SPLIT)


def _per_split(lines: DataFrame, *found: Column) -> DataFrame:
    """A row per split. The last conditions always hold; they ask for all columns of the
    lines, so that their one shuffle serves here too."""
    rows = lines.groupBy(*_SPLIT).agg(*found, F.max(F.length("line") + F.length("file_name") + F.col("nth")).alias("_most"))
    return rows.where(F.col("_most") >= 0).drop("_most")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(file_name, number, line): lines numbered from 1 in each file."""
    counts = _per_split(lines, F.count("*").alias("lines"))
    before = counts.select(*_SPLIT, F.coalesce(F.sum("lines").over(_earlier_splits()), F.lit(0)).alias("before"))
    own = lines.withColumn("own", F.row_number().over(_in_order()))
    return own.join(before, list(_SPLIT)).select("file_name", (F.col("before") + F.col("own")).alias("number"), "line")


def quoted_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, is_first, record): lines joined where a quoted cell goes on over their ends.

    A line begins a record if an even number of quotes stands before it in its file. That
    holds for files in which each cell with a quote is quoted and its quotes are doubled.
    Lines that are a record alone, nearly all, move no further; the others, and the last
    of each split, meet by record.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    counted = lines.withColumn("quotes", quotes).withColumn("before", F.coalesce(F.sum("quotes").over(_in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    even = F.col("before") % 2 == 0
    # A split's last record begins at one line or another, as the quotes before the split say.
    splits = _per_split(
        counted, F.sum("quotes").alias("quotes"), F.max(F.when(even, F.col("nth"))).alias("last_even"), F.max(F.when(~even, F.col("nth"))).alias("last_odd")
    )
    outside = F.coalesce(F.sum("quotes").over(_earlier_splits()), F.lit(0)) % 2
    known = splits.withColumn("outside", outside).withColumn("last", F.when(F.col("outside") == 0, F.col("last_even")).otherwise(F.col("last_odd")))
    known = known.select(*_SPLIT, "outside", F.last("last", ignorenulls=True).over(_earlier_splits()).alias("carried"))

    begins = (F.col("outside") + F.col("before")) % 2 == 0
    placed = counted.join(known, list(_SPLIT)).withColumn("begins", begins)
    record = F.coalesce(F.last(F.when(F.col("begins"), F.col("nth")), ignorenulls=True).over(_in_order()), F.col("carried"))
    placed = placed.select(
        *_SPLIT, "nth", "line", record.alias("record"),
        (F.col("begins") & F.coalesce(F.lead("begins").over(_in_order()), F.lit(False))).alias("alone"),
        ((F.col("split") == 0) & (F.row_number().over(_in_order()) == 1)).alias("is_first"),
    )
    joined = placed.where(~F.col("alone")).groupBy("file", "record").agg(
        F.max("is_first").alias("is_first"), F.sort_array(F.collect_list(F.struct("split", "nth", "line"))).alias("lines")
    )
    whole = joined.select("file", "is_first", F.array_join(F.col("lines.line"), "\n").alias("record"))
    return placed.where("alone").select("file", "is_first", F.col("line").alias("record")).unionByName(whole)
