"""Toxicity of whole texts: boosted trees over dense features, with isotonic calibration.

The lexicon is learned as well: words, and beginnings of words, that toxic training texts
use far more often than others. Features are densities and counts of those terms, how
close they stand to a second person, capitals, signs, and terms hidden by look-alikes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.llm.common import Words, slices, texts_of, written
from storelens.llm.labelled import TRAINING_ROWS, binned, cut_points, sigmoid, training_rows
from storelens.llm.similarity import Shingled

# Second-person words of the corpus languages, and look-alike signs.
SECOND_PERSON = frozenset(
    "you your yours yourself u ya du dich dir dein deine ihr euch euer tu te toi ton vous votre vos tú ti usted ustedes tus".split()
)
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})
PREFIXES = (4, 5, 6)
NEARBY = 5  # words between a term and a second person
LEXICON_TERMS = 4_000
TERMS_KEPT = 100_000  # distinct terms a task adds up before it hands them on; bounds memory
MIN_EVIDENCE = 25.0  # likelihood ratio (G) of a term against chance
MIN_ODDS = 4.0
ENDS = "!?.,;:\"')"
EDGES = re.compile(r"^\W+|\W+$")

FEATURES = (
    "words", "hits", "density", "prefix_hits", "prefix_density", "weight", "strongest", "near_second_person",
    "second_person", "hidden", "mixed_words", "capital_words", "capitals", "signs", "exclamations",
)


# ---- lexicon --------------------------------------------------------------------


def terms_of(word: str) -> list[str]:
    """The bare word, and its beginnings marked by a star."""
    bare = EDGES.sub("", word.lower())
    return [bare, *[bare[:n] + "*" for n in PREFIXES if len(bare) >= n]] if bare else []


def learn_lexicon(training: DataFrame, max_terms: int = LEXICON_TERMS) -> dict[str, float]:
    """Log odds of the terms that toxic texts use more often than chance allows.

    Documents are counted, so a text that repeats a word has no more say. At most
    `max_terms` terms with the strongest evidence reach the driver.
    """

    def rows(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = [*(seen[0].keys() | seen[1].keys())]
        counts = [pa.array([one[t] for t in keys], pa.int64()) for one in seen]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], names=["term", "clean", "toxic"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches, size=2_000_000):
            labels = batch.column("label").to_pylist()
            words = Words(texts_of(batch))
            own = [terms_of(w) for w in words.words]
            for at, label in enumerate(labels):
                used = set(words.codes[words.starts[at] : words.starts[at + 1]].tolist())
                seen[label].update({term for code in used for term in own[code]})
                seen[label][""] += 1
            if len(seen[0]) + len(seen[1]) > TERMS_KEPT:
                yield rows(seen)
                seen = (Counter(), Counter())
        yield rows(seen)

    counted = training.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = written(counted)
    total = counted.where("term = ''").first()
    if not total or not total["clean"] or not total["toxic"]:
        return {}
    share = total["toxic"] / (total["toxic"] + total["clean"])
    n = F.col("toxic") + F.col("clean")
    evidence = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (n * share))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0)
    )
    odds = F.log((F.col("toxic") + 0.5) * (total["clean"] + 1) / ((F.col("clean") + 0.5) * (total["toxic"] + 1)))
    found = (
        counted.where("term <> '' AND toxic > 0")
        .select("term", evidence.alias("evidence"), odds.alias("odds"))
        .where((F.col("evidence") >= MIN_EVIDENCE) & (F.col("odds") >= np.log(MIN_ODDS)))
        .orderBy(F.desc("evidence"), "term").limit(max_terms)
    )
    return {r["term"]: r["odds"] for r in found.collect()}


# ---- features -------------------------------------------------------------------


def _of_word(word: str, lexicon: dict[str, float]) -> tuple[float, ...]:
    """Exact weight, prefix weight, second person, hidden, mixed, all capitals, capitals, signs, exclamations."""
    bare = EDGES.sub("", word.lower())
    exact = lexicon.get(bare, 0.0)
    prefix = max((lexicon.get(bare[:n] + "*", 0.0) for n in PREFIXES), default=0.0)
    alpha = bare.isalpha()
    clear = () if alpha and bare == word.lower() else (bare.translate(LOOK_ALIKES), word.lower().rstrip(ENDS).translate(LOOK_ALIKES))
    hidden = not exact and any(c != bare and c in lexicon for c in clear)
    letters = sum(map(str.isalpha, word))
    return (
        exact, prefix, float(bare in SECOND_PERSON), float(hidden),
        float(bool(bare) and not alpha and any(map(str.isalpha, bare))),
        float(letters > 1 and word.isupper()), float(sum(map(str.isupper, word))),
        float(len(word) - sum(map(str.isalnum, word))), float(word.count("!")),
    )


def features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """One row of FEATURES per text, finite for every text; all 0 for one without words."""
    words = Words(texts)
    of_word = np.array([_of_word(w, lexicon) for w in words.words]).reshape(-1, 9)
    exact, prefix, person, hidden, mixed, shouted, capitals, signs, exclamations = of_word.T
    n = words.counts()
    per = 1 / np.maximum(n, 1)
    chars = np.maximum(words.sums(np.fromiter(map(len, words.words), float, len(words.words))), 1)
    weight = np.maximum(exact, prefix) + 3.0 * hidden
    strongest = np.zeros(len(n))
    filled = np.flatnonzero(n)
    if len(filled):
        strongest[filled] = np.maximum.reduceat(weight[words.codes], words.starts[:-1][filled])
    persons = np.concatenate([[0], np.cumsum(person[words.codes])])
    at = np.flatnonzero(weight[words.codes] > 0)
    of_text = np.searchsorted(words.starts, at, side="right") - 1
    low, high = np.maximum(at - NEARBY, words.starts[of_text]), np.minimum(at + NEARBY + 1, words.starts[of_text + 1])
    near = np.bincount(of_text, persons[high] > persons[low], minlength=len(n))
    hits, prefix_hits = words.sums(exact > 0), words.sums(prefix > 0)
    return np.stack([
        np.log1p(n), np.log1p(hits), hits * per, np.log1p(prefix_hits), prefix_hits * per, words.sums(weight) * per,
        strongest, np.log1p(near), words.sums(person) * per, np.log1p(words.sums(hidden)), words.sums(mixed) * per,
        words.sums(shouted) * per, words.sums(capitals) / chars, words.sums(signs) / chars, words.sums(exclamations) * per,
    ], axis=1)


# ---- boosted trees --------------------------------------------------------------


class Trees:
    """Gradient-boosted trees of a fixed depth over binned features, logistic loss.

    A tree is a complete binary one: per node a feature and a limit, per leaf a value.
    """

    def __init__(self, depth: int = 3, rounds: int = 80, rate: float = 0.15, bins: int = 48, l2: float = 1.0, min_rows: float = 8) -> None:
        self.depth, self.rounds, self.rate, self.bins, self.l2, self.min_rows = depth, rounds, rate, bins, l2, min_rows
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [cut_points(x[:, k], self.bins) for k in range(x.shape[1])]
        codes = binned(x, self.cuts)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(margin)
            tree, step = self._grow(codes, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += step
        return self

    def _grow(self, codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray):
        n_features, width = codes.shape[1], self.bins + 1
        node = np.zeros(len(gradient), np.int64)
        feature, limit = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width)
        for level in range(self.depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for k in range(n_features):
                key = (node * width + codes[:, k])
                g, h, n = (
                    np.cumsum(np.bincount(key, w, minlength=nodes * width).reshape(nodes, width), axis=1)
                    for w in (gradient, hessian, None)
                )
                gain = g**2 / (h + self.l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.l2) - g[:, -1:] ** 2 / (h[:, -1:] + self.l2)
                gain[(n < self.min_rows) | (n[:, -1:] - n < self.min_rows)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = np.flatnonzero(top > best)
                best[better], feature[first + better], limit[first + better] = top[better], k, at[better]
            node = 2 * node + (codes[np.arange(len(node)), feature[first + node]] > limit[first + node])
        leaves = 2**self.depth
        value = self.rate * np.bincount(node, gradient, minlength=leaves) / (np.bincount(node, hessian, minlength=leaves) + self.l2)
        return (feature, limit, value), value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = binned(x, self.cuts)
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (codes[rows, feature[at]] > limit[at])
            total += value[node]
        return total


class Isotonic:
    """The non-decreasing step function nearest to labels over margins (pooled neighbours),
    joined by straight lines between the pools."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # mean, rows, sum of margins
        for m, label in zip(margin[order], y[order].astype(float), strict=True):
            pools.append([label, 1.0, m])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                mean, rows, total = pools.pop()
                last = pools[-1]
                pools[-1] = [(last[0] * last[1] + mean * rows) / (last[1] + rows), last[1] + rows, last[2] + total]
        # A pool's mean with one row of each label added, so that no score is certain.
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.maximum.accumulate(np.array([(p[0] * p[1] + 0.5) / (p[1] + 1) if p[1] < 20 else p[0] for p in pools]))
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.x, self.y), 0.0, 1.0)


class ToxicityModel:
    """Lexicon, trees and calibration; the calibration is learned on rows whose trees did not see them."""

    folds = 4

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray) -> None:
        self.lexicon = lexicon
        self.share = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if len(np.unique(y)) < 2 or len(y) < 2 * self.folds:
            return
        fold = np.arange(len(y)) % self.folds
        margin = np.zeros(len(y))
        for k in range(self.folds):
            margin[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.trees, self.calibrate = Trees().fit(x, y), Isotonic().fit(margin, y)

    def score(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for every text. Without two classes to learn from, the share of label 1."""
        if self.trees is None:
            return np.full(len(texts), self.share)
        return self.calibrate(self.trees.margin(features(texts, self.lexicon)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Learn `labels.toxic` from at most `max_rows` labelled texts (see `training_rows`).

    Of near copies one teaches, or the words of a much-copied text would pass for evidence.
    The texts are read where they lie; the driver gets the lexicon (LEXICON_TERMS at most)
    and one row of features per training text.
    """
    training = written(one_per_family(training_rows(docs, labels, "toxic", max_rows)))
    lexicon = learn_lexicon(training)
    x, y = training_features(training, lambda texts: features(texts, lexicon), len(FEATURES))
    return ToxicityModel(lexicon, x, y)


def one_per_family(training: DataFrame) -> DataFrame:
    """Of training texts that share their smallest 5-word shingle, as most near copies do,
    the one with the smallest doc_id; of those without words, one."""

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = Shingled(texts_of(batch))
            least = np.zeros(batch.num_rows, np.uint64)
            filled = np.flatnonzero(made.counts)
            if len(filled):
                least[filled] = np.minimum.reduceat(made.hashes, made.starts[:-1][filled])
            yield batch.append_column("family", pa.array(least.astype(np.int64)))

    marked = training.mapInArrow(families, "doc_id long, text string, label int, family long")
    first = F.row_number().over(W.partitionBy("family").orderBy("doc_id"))
    return marked.withColumn("nth", first).where("nth = 1").select("doc_id", "text", "label")


def training_features(training: DataFrame, make, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training rows, in the order of their doc_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = pa.array(make(texts_of(batch)).astype(np.float64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "x"])

    got = training.mapInArrow(rows, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, width))
    return x, got["label"].to_numpy(int)


def scored(docs: DataFrame, model, threshold: float, *kept: str) -> DataFrame:
    """`kept` columns with score and predicted for every row; NULL and empty texts have a score too.

    Equal texts score alike, and repeated rows are all kept. `model` needs `score(texts)`.
    """
    names = [docs.schema[k].simpleString().replace(":", " ", 1) for k in kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.score(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*kept, "score", "predicted"],
            )

    return docs.select(*kept, "text").mapInArrow(score, ", ".join([*names, "score double", "predicted int"]))


def rows_by_score(docs: DataFrame, model, threshold: float, keep_above: bool) -> DataFrame:
    """All columns of the rows whose score lies at or above the threshold, or below it."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            above = model.score(texts_of(batch)) >= threshold
            yield batch.filter(pa.array(above if keep_above else ~above))

    return docs.mapInArrow(choose, docs.schema)
