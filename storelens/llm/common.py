"""Shared helpers of the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.scratch import scratch_folder

# Text that a task works on at a time, in bytes; it bounds memory, not results.
SLICE_BYTES = 3_000_000
# The same for work on single code points, which takes some 50 bytes each.
POINT_SLICE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under the cluster's shared one."""
    return f"{scratch_folder(spark)}-{uuid.uuid4().hex[:8]}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: what follows never
    sends a lost executor back past these files."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remainder_of_id(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def worker_store(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from one task to the next."""
    store = sys.modules.setdefault("_storelens_worker", types.ModuleType("_storelens_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as strings; NULL is the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, a longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # or a worker keeps its largest batch


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Words:
    """White-space separated words of a batch of texts: `codes` into the distinct `words`,
    and `starts` with the first word of each text, one entry more than there are texts."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        starts = lists.offsets.to_numpy().astype(np.int64)
        codes = flat.dictionary_encode()
        all_codes = codes.indices.to_numpy()
        self.words: np.ndarray = codes.dictionary.to_numpy(zero_copy_only=False)
        starts = starts - starts[0]
        # Splitting leaves an empty word before leading and after trailing space.
        empty = np.flatnonzero(self.words == "")
        if len(empty):
            kept = all_codes != empty[0]
            before = np.concatenate([[0], np.cumsum(kept)])
            starts, all_codes = before[starts], all_codes[kept]
        self.codes, self.starts = all_codes, starts

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value that belongs to each distinct word."""
        total = np.concatenate([[0], np.cumsum(values[self.codes], dtype=np.float64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


class CodePoints:
    """All code points of a batch of texts in one array, with the start of each text."""

    def __init__(self, texts: list[str]) -> None:
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]
