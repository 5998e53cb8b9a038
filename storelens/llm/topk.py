"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt to a few lists. An item's score is the sum of its scores
in the lists, so an item of total t or more has t / lists or more in one of them.
Phase 1 gathers the best of every list and resolves them; the k-th best total is a score
that the answer reaches at least. Phase 2 takes that cutoff to every task, which collects
the items that reach the uniform threshold in some list and whose upper bound (the
threshold, where a list's score lies below it) reaches the cutoff. Phase 3 resolves the
list scores those still lack and ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.llm.common import written

LISTS = 4
QUERY_BLOCK = 2048  # queries sent to the tasks at once
SCORES_AT_ONCE = 4_000_000  # bounds a task's score matrices
FOUND = "query_id long, vec_id long, score long"
RESULT = "query_id long, rank int, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * component) of the vectors that take part: not NULL and
    without NULL or non-finite components, with an id; a NULL vec_id names no row and is left
    out. A component whose product is no 64-bit number fails the query."""
    x = F.col("embedding")
    wide = F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("long")
    whole = lambda c: F.when(F.abs(F.lit(scale) * c.cast("double")) >= float(2**63), wide).otherwise(F.floor(F.lit(scale) * c.cast("double")))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the width, and their rows; vectors of other lengths have no score."""
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(lengths == width)
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), width), rows


def _list_scores(items: np.ndarray, queries: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Exact list scores, items x queries: in doubles where every sum is a whole number they hold, in
    longs where no sum can pass them, else in Python's integers. A score beyond 62 bits is an error."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))  # noqa: E731  the least long has no absolute value
    top = most(items) * most(queries) * items.shape[1]
    if top < 2**62:
        kind = np.float64 if top < 2**53 else np.int64
        return [items[:, p].astype(kind) @ queries[:, p].T.astype(kind) for p in parts]
    exact = [items[:, p].astype(object) @ queries[:, p].T.astype(object) for p in parts]
    if any(abs(x) >= 2**62 for scores in [*exact, sum(exact)] for x in scores.flat):
        raise OverflowError("an inner product does not fit 62 bits; take a smaller scale")
    return [scores.astype(np.int64) for scores in exact]


def _phase(query_ids: np.ndarray, queries: np.ndarray, k: int, lists: int, cutoffs: np.ndarray | None):
    width = queries.shape[1]
    parts = [p for p in np.array_split(np.arange(width), lists) if len(p)] or [np.arange(0)]  # one empty list for no components
    step = max(1, SCORES_AT_ONCE // max(1, len(query_ids)))

    def gather(scores: list[np.ndarray], ids: np.ndarray, own: np.ndarray):
        """Phase 1: the k best of every list, resolved; the k best totals among them."""
        total = sum(scores)
        chosen = np.zeros(total.shape, bool)
        for s in scores:
            s = np.where(own, -np.inf if s.dtype.kind == "f" else np.iinfo(np.int64).min + 1, s)
            top = np.argpartition(-s, min(k, len(s)) - 1, axis=0)[:k] if len(s) > k else np.tile(np.arange(len(s))[:, None], s.shape[1])
            np.put_along_axis(chosen, top, True, axis=0)
        return total, chosen & ~own

    def collect(scores: list[np.ndarray], ids: np.ndarray, own: np.ndarray):
        """Phases 2 and 3: what some list shows to be good enough, by upper bound, then exactly."""
        least = cutoffs.astype(scores[0].dtype)
        threshold = least // len(scores)
        bound, seen = np.zeros(own.shape, least.dtype), np.zeros(own.shape, bool)
        for s in scores:
            seen |= s >= threshold
            bound += np.maximum(s, threshold)
        item, query = np.nonzero(seen & ~own & (bound >= least))
        total = np.zeros(own.shape, scores[0].dtype)
        total[item, query] = sum(s[item, query] for s in scores)
        chosen = np.zeros(own.shape, bool)
        chosen[item, query] = total[item, query] >= least[query]
        return total, chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rows = _matrix(batch.column("v"), width)
            ids = batch.column("vec_id").to_numpy()[rows]
            for at in range(0, len(rows), step):
                some = ids[at : at + step]
                scores = _list_scores(items[at : at + step], queries, parts)
                total, chosen = (gather if cutoffs is None else collect)(scores, some, some[:, None] == query_ids[None, :])
                item, query = np.nonzero(chosen)
                if not len(item):
                    continue
                score = total[item, query].astype(np.int64)
                order = np.lexsort((some[item], -score, query))
                item, query, score = item[order], query[order], score[order]
                first = np.searchsorted(query, query, side="left")
                kept = np.arange(len(query)) - first < k  # no task hands on more than k of a query's ties
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[query[kept]]), pa.array(some[item[kept]]), pa.array(score[kept])], names=["query_id", "vec_id", "score"]
                )

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, lists: int = LISTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k highest inner products of every query among all rows of other ids (RESULT).

    `vectors` has vec_id and integer vectors v; `is_query` is a condition on vec_id. Ties
    go to smaller ids. Scores are exact; one beyond 62 bits, of a list or in all, fails the query. Vectors of another length than the query's take no part in its
    answer (empty vectors score 0 with each other); fewer than k others give fewer ranks; an empty table gives no row. Of rows
    that repeat a query's id one vector (the least) asks; repeated candidates each count.

    Queries go to the tasks in blocks of `query_block`, whose size bounds what is sent,
    the cutoffs included; every task hands on at most k rows a query and batch.
    """
    spark = vectors.sparkSession
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    asked = written(asked)
    parts = []
    for width, n in sorted((r["width"], r["n"]) for r in asked.groupBy("width").agg(F.count("*").alias("n")).collect()):
        last = None
        for _ in range(-(-n // query_block)):
            block = asked.where(F.col("width") == width)
            block = (block if last is None else block.where(F.col("vec_id") > last)).orderBy("vec_id").limit(query_block).collect()
            last = block[-1]["vec_id"]
            ids = np.array([r["vec_id"] for r in block], np.int64)
            queries = np.array([r["v"] for r in block], np.int64).reshape(len(block), width)
            gathered = vectors.mapInArrow(_phase(ids, queries, k, lists, None), FOUND)
            by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            ranked = gathered.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
            cutoffs = np.full(len(ids), -(2**62))  # fewer than k others: everything counts
            for r in ranked.collect():
                cutoffs[np.searchsorted(ids, r["query_id"])] = r["score"]
            found = vectors.mapInArrow(_phase(ids, queries, k, lists, cutoffs), FOUND)
            best = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
            parts.append(best.select("query_id", "rank", "vec_id", "score"))
            if n > query_block:
                parts[-1] = written(parts[-1])
    if not parts:
        return spark.createDataFrame([], RESULT)
    while len(parts) > 1:
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return parts[0]
