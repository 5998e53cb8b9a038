"""Policy pages to section-aware passages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.functions.columns import lookup, strip
from storelens.functions.text import split_recursively
from storelens.lookups import (
    CHUNK_CHARS,
    CHUNK_OVERLAP,
    CHUNK_SEPARATORS,
    DEFAULT_SECTION,
    DOCUMENT_TITLES,
    HEADING,
    MIN_FRAGMENT_CHARS,
    SECTION_BREAK,
)

# Pages whose fragments are ordered by one task; longer documents are cut into blocks.
PAGES_PER_BLOCK = 512

# Unicode digits and blanks, as the patterns mean them.
_UNICODE = "(?U)"


def document_title(stem: Column | str, titles: dict[str, str] = DOCUMENT_TITLES) -> Column:
    stem = F.col(stem) if isinstance(stem, str) else stem
    return lookup(stem, titles, default=stem)


def page_fragments(pages: DataFrame) -> DataFrame:
    """Fragments of each page cut at numbered headings, with the heading they start with.

    Fragments under the minimum length go before their heading is looked at, so they
    never become the current section.
    """
    parts = F.posexplode(F.split("text", _UNICODE + SECTION_BREAK)).alias("pos", "_part")
    fragments = pages.select("doc_stem", "page_no", parts).select(
        "doc_stem", "page_no", "pos", strip("_part").alias("fragment")
    )
    heading = strip(F.regexp_extract("fragment", _UNICODE + HEADING, 1))
    return fragments.where(F.length("fragment") >= MIN_FRAGMENT_CHARS).withColumn(
        "heading", F.nullif(heading, F.lit(""))
    )


def section_fragments(pages: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Fragments with their section: the own heading, or the last one before it.

    Headings carry over page ends within a document, as a scan in two steps: each block of
    pages finds its own last headings, then a row per block carries the last heading of the
    blocks before. One plan holds for documents of any length; even one that is most of the
    corpus is spread over many tasks. Both steps read the same shuffle, so the text is read
    and moved once, and nothing runs while the plan is made.
    """
    # Keys without NULL, or a join would add conditions below one of the two uses of the shuffle.
    document = F.coalesce(F.concat(F.lit("="), "doc_stem"), F.lit("")).alias("_document")
    block = F.coalesce(F.floor((F.col("page_no") - 1) / pages_per_block), F.lit(-1)).alias("_block")
    fragments = page_fragments(pages).select(document, block, "page_no", "pos", "heading", "fragment").repartition("_document", "_block")
    so_far = W.partitionBy("_document", "_block").orderBy("page_no", "pos")
    placed = fragments.withColumn("_section", F.last("heading", ignorenulls=True).over(so_far))
    return placed.join(_carried_headings(fragments), ["_document", "_block"], "left").select(
        F.when(F.col("_document") != "", F.substr("_document", F.lit(2))).alias("doc_stem"),
        "page_no",
        "pos",
        F.coalesce("_section", "_carried", F.lit(DEFAULT_SECTION)).alias("section"),
        "heading",
        "fragment",
    )


def _carried_headings(fragments: DataFrame) -> DataFrame:
    """The heading each block of a document inherits from the blocks before it, one small row per block."""
    heading = F.struct("page_no", "pos", "heading")
    blocks = fragments.groupBy("_document", "_block").agg(
        F.max(F.when(F.col("heading").isNotNull(), heading)).alias("last"),
        # Always true, but it asks for the text: columns of the shuffle are then those that
        # the fragments themselves need, and one shuffle serves both.
        F.max(F.length("fragment")).alias("longest"),
    ).where(F.col("longest") > 0)
    before = W.partitionBy("_document").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = F.last("last.heading", ignorenulls=True).over(before).alias("_carried")
    return blocks.select("_document", "_block", carried).where(F.col("_carried").isNotNull())


def section_bodies(fragments: DataFrame) -> DataFrame:
    """The text to index: a fragment without a heading of its own gets its section's."""
    body = F.when(
        F.col("heading").isNull(), F.concat("section", F.lit("\n"), "fragment")
    ).otherwise(F.col("fragment"))
    return fragments.select("doc_stem", "page_no", "pos", "section", body.alias("body"))


def recursive_chunks(
    bodies: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Bodies over `size` characters split into overlapping pieces, others kept whole.

    A piece that lost its section heading gets it back, and may so exceed `size`.
    Only the long bodies of a batch take the Python path through the splitter.
    """
    long_body = F.length("body") > size
    pieces = F.when(long_body, _pieces(size, overlap)(F.when(long_body, F.col("body")))).otherwise(
        F.array("body")
    )
    split = bodies.select(
        "doc_stem", "page_no", "pos", "section", long_body.alias("_long"),
        F.posexplode(pieces).alias("piece", "_text"),
    )
    headed = F.when(
        F.col("_long") & ~F.startswith("_text", "section"), F.concat("section", F.lit("\n"), "_text")
    ).otherwise(F.col("_text"))
    return split.select("doc_stem", "page_no", "pos", "piece", "section", headed.alias("text"))


def _pieces(size: int, overlap: int):
    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda body: split_recursively(body, size, overlap, CHUNK_SEPARATORS),
                na_action="ignore",
            )

    return pieces


def policy_chunks(pages: DataFrame, titles: dict[str, str] = DOCUMENT_TITLES) -> DataFrame:
    """Pages to the chunk table: text, document title, section and page."""
    chunks = recursive_chunks(section_bodies(section_fragments(pages)))
    place = F.concat_ws("#", "doc_stem", "page_no", "pos", "piece")
    return chunks.select(
        place.alias("passage_id"),
        "text",
        document_title("doc_stem", titles).alias("title"),
        "section",
        F.col("page_no").alias("page_label"),
    )


def fixed_window_chunks(
    documents: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Windows of `size` characters that start every `size - overlap` ones.

    The text is cut once into consecutive steps; a window is a step plus the head of
    the following text. That is linear in the text, while a `substring` per window
    would count its way from the start each time.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must not exceed half a window")
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = documents.select("doc_id", steps.alias("steps"))
    windows = F.transform(
        "steps",
        lambda part, i: F.concat(
            part, F.coalesce(F.left(F.try_element_at("steps", i + 2), F.lit(overlap)), F.lit(""))
        ),
    )
    return cut.select("doc_id", F.posexplode(windows).alias("window", "text")).select(
        "doc_id", "window", (F.col("window") * step).alias("start"), "text"
    )
