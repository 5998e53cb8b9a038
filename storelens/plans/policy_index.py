"""Policy pages to a searchable passage table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from storelens.lookups import DOCUMENT_TITLES
from storelens.operators.sections import page_fragments, policy_chunks
from storelens.operators.vectors import Encoder, encode_column


def build_index(pages: DataFrame, encoder: Encoder, path: str, titles: dict[str, str] = DOCUMENT_TITLES) -> int:
    """Chunk, encode and store the pages; returns the number of chunks.

    Pages without any text to index are an error and leave a stored table as it is.
    That check stops at the first fragment and moves no data.
    """
    if page_fragments(pages).isEmpty():
        raise FileNotFoundError("no policy documents found: nothing to index")
    # Clustered by passage, so that a citation reads few row groups.
    indexed = encode_column(policy_chunks(pages, titles), encoder).repartitionByRange("passage_id").sortWithinPartitions("passage_id")
    indexed.write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.parquet(path).count()
