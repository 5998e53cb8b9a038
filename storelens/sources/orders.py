"""Orders: the human-edited sheet export and its cleaned Parquet form."""

from __future__ import annotations

from collections.abc import Collection
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.columns import blank_to_null, mixed_date, money, number, whole_number
from storelens.lookups import MISSING_TEXTS
from storelens.schema import DATE_COLUMNS, ORDER_COLUMNS, ORDERS, REQUIRED_ORDER_COLUMNS
from storelens.sources.splits import lines_by_split, quoted_records


def read_orders(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Raw orders as text, columns found by name, "nothing here" texts as NULL.

    No schema inference pass: every column arrives as text and `clean_orders` types
    it. A declared schema is no help, since CSV binds it by position. A quoted cell may
    hold line breaks; which lines belong together is found out split by split, so a large
    file is read by many tasks. Cells with a quote are quoted with their quotes doubled, as
    exports write them. Without `multiline`, for exports known to have no such cells, lines
    are records.
    """
    options = {"escape": '"', "multiLine": str(multiline).lower()}
    plain = spark.read.options(header="true", **options).csv(path)
    raw = plain
    if multiline:
        names = ", ".join("`" + c.replace("`", "``") + "` string" for c in plain.columns)
        records = quoted_records(lines_by_split(spark, path, "\n")).where(~F.col("is_first"))
        text = F.regexp_replace("record", "\r$", "")
        raw = records.select(text.alias("record")).where(F.col("record") != "").select(F.from_csv("record", F.lit(names), options).alias("row")).select("row.*")
    cells = {c: F.col("`" + c.replace("`", "``") + "`") for c in raw.columns}
    return raw.select(*[F.when(~cell.isin(*MISSING_TEXTS), cell).alias(c) for c, cell in cells.items()])


def read_orders_with_fallback(
    spark: SparkSession, primary: str | None, snapshot: str, multiline: bool = True
) -> DataFrame:
    """The primary source, or the snapshot if it is unset, unreadable or malformed.

    Reading is lazy, so one row is fetched to find out. A store that cannot be reached
    reports its own Java error rather than Spark's.
    """
    if primary:
        try:
            orders = read_orders(spark, primary, multiline)
            if set(REQUIRED_ORDER_COLUMNS) <= set(orders.columns):
                orders.limit(1).collect()
                return orders
        except (PySparkException, Py4JJavaError):
            pass
    return read_orders(spark, snapshot, multiline)


def clean_orders(raw: DataFrame, strict_dates: Collection[str] = ("order_date",)) -> DataFrame:
    """Typed orders. Unreadable text in a date column fails the query if the column is
    among `strict_dates`, and is missing otherwise.

    A column the source lacks is NULL throughout, apart from the required ones.
    """
    absent = set(REQUIRED_ORDER_COLUMNS) - set(raw.columns)
    if absent:
        raise ValueError(f"orders lack the columns {sorted(absent)}")
    cleaners = {
        **{c: partial(mixed_date, strict=c in strict_dates) for c in DATE_COLUMNS},
        "unit_price": money,
        "total": money,
        "quantity": whole_number,
        "installments": whole_number,
        "delivery_days": number,
    }
    text = raw.select(
        *[
            (F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")).alias(c)
            for c in ORDER_COLUMNS
        ]
    )
    return text.select(*[cleaners.get(c, blank_to_null)(c).alias(c) for c in ORDER_COLUMNS])


def stream_orders(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Cleaned orders as a stream of the Parquet files that arrive at `path`."""
    reader = spark.readStream.schema(ORDERS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_orders(orders: DataFrame, path: str) -> None:
    """Store cleaned orders so that later queries prune columns and push dates down.

    Files are range-clustered by order date: a period filter then skips whole row
    groups on their min/max statistics, and a busy day may span several files.
    """
    (
        orders.repartitionByRange("order_date", "order_id")
        .sortWithinPartitions("order_date", "order_id")
        .write.mode("overwrite")
        .parquet(path)
    )
