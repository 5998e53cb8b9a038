"""Policy pages in, chunk table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.splits import lines_by_split, numbered_lines

PAGE_BREAK = "\f"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the text files at `path`, pages numbered from 1.

    A form feed closes a page, as text extractors write it; nothing after the last one is
    no page. The document is named by its file stem. A file of any length is read by as
    many tasks as it has splits, and no row is more than a page.
    """
    pages = numbered_lines(lines_by_split(spark, path, PAGE_BREAK))
    stem = F.regexp_extract("file_name", r"^(.*?)(?:\.[^.]*)?$", 1)
    return pages.select(stem.alias("doc_stem"), F.col("number").cast("int").alias("page_no"), F.col("line").alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the stored chunk table; no chunks at all is an error."""
    if chunks.isEmpty():
        raise FileNotFoundError("no policy documents found: nothing to store")
    chunks.write.mode("overwrite").parquet(path)
