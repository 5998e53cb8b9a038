"""Language of whole texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import POINT_SLICE, CodePoints, slices, texts_of, worker_store

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"

MODEL = "lang string, bucket int, n long"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-case letters of each text, and the text each lies in.

    A run of other characters counts as one blank, so n-grams see where words begin and
    end but no digits or signs. An n-gram never spans two texts.
    """
    points = CodePoints([t.lower() for t in texts])
    letter = worker_store("letters", _letters)[points.points]
    of_text = np.repeat(np.arange(len(texts)), np.diff(points.starts))
    first_blank = ~letter
    first_blank[1:] &= letter[:-1] | (of_text[1:] != of_text[:-1])
    kept = letter | first_blank
    symbols = np.where(letter, points.points, 32)[kept].astype(np.uint64)
    of_text = of_text[kept]
    hashed, texts_out = [], []
    running = np.zeros(len(symbols), np.uint64)
    for n in range(1, max(orders) + 1):
        size = len(symbols) - n + 1
        if size <= 0:
            break
        running = running[:size] * np.uint64(0x100000001B3) + symbols[n - 1 :]
        if n in orders:
            same = of_text[:size] == of_text[n - 1 :]
            mixed = (running + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            hashed.append((mixed >> np.uint64(40)) % np.uint64(buckets))
            texts_out.append(of_text[:size])
            hashed[-1], texts_out[-1] = hashed[-1][same], texts_out[-1][same]
    if not hashed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashed).astype(np.int64), np.concatenate(texts_out)


def count_grams(docs: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """How often each hashed n-gram occurs per language, over all labelled texts.

    Rows whose lang or text is NULL teach nothing. Each task adds up its counts before
    the shuffle, so a language with most of the rows is a row per bucket and task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, size=POINT_SLICE):
            langs = batch.column("lang").to_pylist()
            hashed, of_text = grams(texts_of(batch).to_pylist(), orders, buckets)
            names = sorted(set(langs))
            number = np.array([names.index(lang) for lang in langs])
            counted = np.bincount(number[of_text] * buckets + hashed, minlength=len(names) * buckets)
            for name, row in zip(names, counted.reshape(len(names), buckets), strict=True):
                totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            used = np.flatnonzero(row)
            # A language is known even if its texts have no letters.
            used = used if len(used) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array(used, pa.int32()), pa.array(row[used].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return taught.mapInArrow(count, MODEL).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log probabilities by bucket and language, and the languages' log priors.

    The priors are even: how many texts a corpus holds of a language says little about
    the next text. Size is buckets x languages, whatever the corpus.
    """

    def __init__(self, langs: list[str], counts: np.ndarray, orders: tuple[int, ...], smoothing: float) -> None:
        self.langs, self.orders, self.buckets = langs, orders, counts.shape[0]
        total = counts.sum(axis=0, keepdims=True) + smoothing * self.buckets
        self.log_prob = (np.log(counts + smoothing) - np.log(total)).astype(np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities, texts x languages, and the n-grams of each text."""
        hashed, of_text = grams(texts, self.orders, self.buckets)
        sums = np.empty((len(texts), len(self.langs)))
        for column in range(len(self.langs)):
            sums[:, column] = np.bincount(of_text, self.log_prob[hashed, column], minlength=len(texts))
        return sums, np.bincount(of_text, minlength=len(texts))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language, ties to the first by name, and its posterior.

        A text without letters is unknown with score 0.
        """
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, _ = self.scores(texts)
        best = sums.argmax(axis=1)
        posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        letters = worker_store("letters", _letters)
        points = CodePoints(texts)
        known = points.sums(letters[points.points]) > 0
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return langs, np.where(known, posterior, 0.0)


def train(docs: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> LanguageModel:
    """Counts over every labelled text; the driver gets one row per language and bucket."""
    rows = count_grams(docs, orders, buckets).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((buckets, len(langs)))
    number = {lang: k for k, lang in enumerate(langs)}
    counts[rows["bucket"].to_numpy(int), rows["lang"].map(number).to_numpy(int)] = rows["n"].to_numpy(float)
    return LanguageModel(langs, counts, orders, smoothing)


def predict_languages(docs: DataFrame, model: LanguageModel, *kept: str) -> DataFrame:
    """`kept` columns with lang_pred and score for every row.

    A NULL, empty or letterless text is `und` with score 0, and so is every text if the
    model knows no language. Equal texts score alike, and equal rows are all kept.
    """
    names = [docs.schema[k].simpleString().replace(":", " ", 1) for k in kept]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=POINT_SLICE):
            langs, scores = model.predict(texts_of(batch).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(langs, pa.string()), pa.array(scores)],
                names=[*kept, "lang_pred", "score"],
            )

    return docs.select(*kept, "text").mapInArrow(predict, ", ".join([*names, "lang_pred string", "score double"]))
