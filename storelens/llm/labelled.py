"""Labelled rows that a classifier learns from, and what both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a classifier learns from at most; the rest of the labels add nothing but time.
TRAINING_ROWS = 30_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """Texts with their label (text, label 0 or 1): at most `max_rows`, those whose doc_id has the
    smallest hash, whatever their order. Repeated labels of a document count once, as 1 if any is;
    a NULL label or doc_id teaches nothing. The labels, bounded by `max_rows`, go to the texts."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 increasing limits that part the values evenly."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def binned(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    columns = [np.searchsorted(c, features[:, k], side="left") for k, c in enumerate(cuts)]
    return np.stack(columns, axis=1).astype(np.int64)
