"""Encoding of passages, nearest passages and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.columns import strip
from storelens.lookups import (
    DEFAULT_PAGE,
    DEFAULT_TITLE,
    NO_PASSAGES,
    PASSAGE_BREAK,
    PASSAGE_PREFIX,
    QUERY_PREFIX,
    TOP_PASSAGES,
)

Encoder = Callable[[list[str]], np.ndarray]
Question = tuple[str, Sequence[float]]

# Scores are compared at this precision, so equal vectors tie in any summation order.
SCORE_DIGITS = 9
# Bounds the score matrix a task holds at a time, whatever the number of questions.
SCORES_AT_ONCE = 4_000_000


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths == 0, 1, lengths)


def encode_column(
    rows: DataFrame, encoder: Encoder, text: str = "text", output: str = "embedding", prefix: str = PASSAGE_PREFIX
) -> DataFrame:
    """Add the unit vector of a text column, batch by batch inside the tasks.

    The encoder is the caller's: it maps a list of texts to a matrix. It is shipped
    once per task; a model should be loaded lazily on first use.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])
    kept = rows.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [prefix + (t or "") for t in batch.column(text).to_pylist()]
            matrix = _unit_rows(np.asarray(encoder(texts), dtype="float64")).astype("float32")
            flat = pa.array(matrix.ravel())
            offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype="int32"))
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(offsets, flat)], names=[*kept, output]
            )

    return rows.mapInArrow(encode, schema)


def encode_question(question: str, encoder: Encoder) -> list[float]:
    """The unit vector of a single question."""
    return _unit_rows(np.asarray(encoder([QUERY_PREFIX + question]), dtype="float64"))[0].tolist()


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def top_passages(
    passages: DataFrame,
    questions: Sequence[Question],
    k: int = TOP_PASSAGES,
    key: str = "passage_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k passages nearest to each question, exactly, by inner product.

    Questions are vectors the caller holds. Every task scores its batches against
    all of them and hands on its own best k per question, so question-passage pairs
    never become rows; the final rank is over k rows per question and task. Equal
    scores rank by key. A passage whose vector is missing, of another length than the
    questions' or holds a NULL, NaN or infinity is left out.
    """
    names = [name for name, _ in questions]
    if not names or len(set(names)) < len(names):
        raise ValueError("questions need distinct names, and at least one is needed")
    dimension = len(questions[0][1])
    if not dimension or any(len(v) != dimension for _, v in questions):
        raise ValueError("questions need vectors of one length")
    matrix = np.array([v for _, v in questions], dtype="float64").T
    if not np.isfinite(matrix).all():
        raise ValueError("questions need finite vectors")
    key_field = passages.schema[key]
    schema = T.StructType([
        T.StructField("question", T.StringType()),
        T.StructField(key, key_field.dataType),
        T.StructField("score", T.DoubleType()),
    ])

    rows_at_once = max(1, SCORES_AT_ONCE // len(names))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table | None] = [None] * len(names)
        worst = np.full(len(names), -np.inf)
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                vectors = values.reshape(batch.num_rows, -1).astype("float64")
                scores = np.round(vectors @ matrix, SCORE_DIGITS)
                # Soon hardly any passage still makes it among a question's best.
                for q in np.flatnonzero(scores.max(axis=0) >= worst):
                    good = scores[:, q] >= worst[q]
                    found = pa.table({key: batch.column(0), "score": scores[:, q]}).filter(pa.array(good))
                    if kept[q] is not None:
                        found = pa.concat_tables([kept[q], found])
                    kept[q] = found.sort_by([("score", "descending"), (key, "ascending")]).slice(0, k)
                    if kept[q].num_rows == k:
                        worst[q] = kept[q]["score"][k - 1].as_py()
        for name, rows in zip(names, kept):
            if rows is not None:
                labelled = pa.table({
                    "question": pa.array([name] * rows.num_rows, pa.string()),
                    key: rows[key],
                    "score": rows["score"],
                })
                yield from labelled.combine_chunks().to_batches()

    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), key))
    return (
        passages.where((F.size(vector) == dimension) & F.forall(vector, _finite))
        .select(key, vector)
        .mapInArrow(best, schema)
        .withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select("question", "rank", key, "score")
    )


def format_passages(found: DataFrame, questions: Sequence[Question]) -> DataFrame:
    """One cited text per question out of its ranked passages (`text, title, page_label`).

    A question without passages says so. At most k passages meet in one row.
    """
    title = F.coalesce("title", F.lit(DEFAULT_TITLE))
    page = F.coalesce(F.col("page_label").cast("string"), F.lit(DEFAULT_PAGE))
    block = F.concat(F.lit("["), title, F.lit(" — p. "), page, F.lit("]\n"), strip("text"))
    answers = found.groupBy("question").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks")
    )
    joined = F.array_join(F.col("blocks.block"), PASSAGE_BREAK)
    asked = found.sparkSession.createDataFrame([(name,) for name, _ in questions], "question string")
    return asked.join(answers, "question", "left").select(
        "question", F.coalesce(joined, F.lit(NO_PASSAGES)).alias("answer")
    )


def search_policies(
    chunks: DataFrame, question: str, encoder: Encoder, k: int = TOP_PASSAGES, key: str = "passage_id"
) -> DataFrame:
    """One row: the k nearest chunks to a question as cited text.

    `chunks` needs `key, text, title, page_label, embedding`.
    """
    questions = [(question, encode_question(question, encoder))]
    nearest = top_passages(chunks, questions, k, key)
    return format_passages(cited(nearest, chunks, key), questions)


def cited(nearest: DataFrame, passages: DataFrame, key: str = "passage_id") -> DataFrame:
    """Ranked passages with their text and source, looked up by their keys.

    The search runs first; the driver gets its answer, k keys and scores per question the
    caller passed in, as it gets the cited text after all. The keys then go into the scan
    of `passages` as a condition: a store that is clustered by key, as `build_index` writes
    it, reads the row groups that hold them, and no text is shuffled.
    """
    found = nearest.collect()
    ranked = nearest.sparkSession.createDataFrame(found, nearest.schema)
    keys = sorted({r[key] for r in found})
    texts = passages.select(key, "text", "title", "page_label").where(F.col(key).isin(keys))
    return ranked.join(texts, key)
