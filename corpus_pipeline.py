"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import decontamination, packing, quality, similarity, toxicity
from storelens.llm.common import remainder_of_id, table, written

# As in the operators' own queries.
TOXIC_FROM = 0.5
GOOD_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity lies below the threshold; a fifth of the labels is left for tests."""
    model = toxicity.train(docs.where(remainder_of_id(5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.rows_by_score(docs, model, TOXIC_FROM, keep_above=False)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality reaches the threshold."""
    model = quality.train(docs.where(remainder_of_id(5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.rows_by_score(docs, model, GOOD_FROM, keep_above=True)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near duplicates."""
    return similarity.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# Models, signatures and tokenizers have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each stage's rows written and read back."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
