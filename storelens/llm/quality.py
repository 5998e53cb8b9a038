"""Quality of whole texts: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, built by boosting shallow trees on one
feature after the other, round after round; the strongest pairs of features then get
tables over both their bins in the same way. A text's margin is the sum of one entry per
table, so scoring is a handful of vector additions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storelens.llm.common import Words, written
from storelens.llm.labelled import TRAINING_ROWS, binned, cut_points, sigmoid, training_rows
from storelens.llm.toxicity import training_features

FEATURES = (
    "words", "word_length", "distinct_words", "top_word", "repeated_words", "one_letter", "lower", "upper", "capital_words",
    "digits", "signs", "exclamations", "bars", "odd_signs", "sign_words", "lines", "line_words", "repeated_lines", "sentence_ends",
    "halves_alike",
)
ODD_SIGNS = frozenset("#$%&*=~^<>{}[]\\@_+")  # fixed values


def _of_word(word: str) -> tuple[float, ...]:
    letters = sum(map(str.isalpha, word))
    uppers = sum(map(str.isupper, word))
    digits = sum(map(str.isdigit, word))
    return (
        len(word), letters - uppers, uppers, float(letters > 1 and uppers == letters), digits,
        len(word) - letters - digits, word.count("!"), word.count("|"), sum(c in ODD_SIGNS for c in word),
        float(letters + digits == 0), float(letters == 1 == len(word)), float(word[-1:] in ".?!"),
    )


def _repeats(of_text: np.ndarray, codes: np.ndarray, n_codes: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, how many distinct codes it has and how often its commonest one occurs."""
    if not len(codes):
        return np.zeros(n_texts), np.zeros(n_texts)
    keys, counts = np.unique(of_text * n_codes + codes, return_counts=True)
    owner = keys // n_codes
    top = np.zeros(n_texts)
    np.maximum.at(top, owner, counts)
    return np.bincount(owner, minlength=n_texts).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, finite for every text."""
    words = Words(texts)
    n_texts = len(texts)
    n = words.counts()
    of_word = np.array([_of_word(w) for w in words.words], float).reshape(-1, 12)
    length, lower, upper, shouted, digits, signs, exclamations, bars, odd, sign_words, single, ends = (
        words.sums(column) for column in of_word.T
    )
    per, chars = 1 / np.maximum(n, 1), np.maximum(length, 1)
    of_text = np.repeat(np.arange(n_texts), n)
    distinct, top = _repeats(of_text, words.codes.astype(np.int64), max(len(words.words), 1), n_texts)
    same = np.zeros(len(words.codes))
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (of_text[1:] == of_text[:-1])
    adjacent = np.bincount(of_text, same, minlength=n_texts)

    line_of, line_codes, lengths = [], [], []
    known: dict[str, int] = {}
    halves = np.zeros(n_texts)
    for at, text in enumerate(texts.to_pylist()):
        lines = [line for line in text.split("\n") if line.strip()]
        line_of += [at] * len(lines)
        line_codes += [known.setdefault(line, len(known)) for line in lines]
        lengths.append(len(lines))
        own = words.codes[words.starts[at] : words.starts[at + 1]]
        # How much of the second half the first half's words cover.
        middle = len(own) // 2
        halves[at] = np.isin(own[middle:], own[:middle]).mean() if middle else 0.0
    n_lines = np.array(lengths, float)
    different, _ = _repeats(np.array(line_of, np.int64), np.array(line_codes, np.int64), max(len(known), 1), n_texts)
    return np.stack([
        np.log1p(n), length * per, distinct * per, top * per, adjacent * per, single * per, lower / chars, upper / chars,
        shouted * per, digits / chars, signs / chars, exclamations * per, bars * per, odd / chars, sign_words * per,
        np.log1p(n_lines), n / np.maximum(n_lines, 1), 1 - different / np.maximum(n_lines, 1), ends * per, halves,
    ], axis=1)


class AdditiveModel:
    """Lookup tables per feature and per pair, fitted by cyclic boosting with logistic loss."""

    def __init__(self, bins: int = 32, rounds: int = 150, rate: float = 0.08, leaves: int = 4, pairs: int = 8,
                 pair_bins: int = 8, pair_rounds: int = 80, l2: float = 2.0, min_rows: float = 5) -> None:
        self.bins, self.rounds, self.rate, self.leaves = bins, rounds, rate, leaves
        self.n_pairs, self.pair_bins, self.pair_rounds, self.l2, self.min_rows = pairs, pair_bins, pair_rounds, l2, min_rows

    def _steps(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The values of a shallow tree over ordered bins: the best splits first, a mean per leaf."""
        cuts = [0, len(g)]
        total_g, total_h, total_n = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))

        def score(a, b):
            return (total_g[b] - total_g[a]) ** 2 / (total_h[b] - total_h[a] + self.l2)

        while len(cuts) <= self.leaves:
            best = (1e-9, 0)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = np.arange(a + 1, b)
                at = at[(total_n[at] - total_n[a] >= self.min_rows) & (total_n[b] - total_n[at] >= self.min_rows)]
                if len(at):
                    gain = score(a, at) + score(at, b) - score(a, b)
                    best = max(best, (float(gain.max()), int(at[gain.argmax()])))
            if not best[1]:
                break
            cuts = sorted([*cuts, best[1]])
        value = np.empty(len(g))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            value[a:b] = self.rate * (total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + self.l2)
        return value

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.cuts = [cut_points(x[:, k], self.bins) for k in range(x.shape[1])]
        self.pair_cuts = [cut_points(x[:, k], self.pair_bins) for k in range(x.shape[1])]
        codes, coarse = binned(x, self.cuts), binned(x, self.pair_cuts)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        for _ in range(self.rounds):
            for k, table in enumerate(self.tables):
                p = sigmoid(margin)
                size, own = len(table), codes[:, k]
                step = self._steps(*(np.bincount(own, w, minlength=size) for w in (y - p, p * (1 - p), None)))
                table += step
                margin += step[own]

        width = self.pair_bins + 1
        cells = lambda i, j: coarse[:, i] * width + coarse[:, j]
        p = sigmoid(margin)

        def strength(pair: tuple[int, int]) -> float:
            """How much a free value per cell would still lower the loss."""
            g, h = (np.bincount(cells(*pair), w, minlength=width * width) for w in (y - p, p * (1 - p)))
            return float((g**2 / (h + self.l2)).sum())

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda pair: (-strength(pair), pair))
        self.pairs = ranked[: self.n_pairs]
        self.pair_tables = [np.zeros(width * width) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for pair, table in zip(self.pairs, self.pair_tables, strict=True):
                p = sigmoid(margin)
                own = cells(*pair)
                g, h, n = (np.bincount(own, w, minlength=width * width).reshape(width, width) for w in (y - p, p * (1 - p), None))
                # A tree that first parts one feature, then the other within each part.
                rows = self._steps(g.sum(1), h.sum(1), n.sum(1))
                step = np.empty((width, width))
                for level in np.unique(rows):
                    part = rows == level
                    step[part] = self._steps(g[part].sum(0), h[part].sum(0), n[part].sum(0))
                table += step.ravel()
                margin += step.ravel()[own]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes, coarse = binned(x, self.cuts), binned(x, self.pair_cuts)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[codes[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[:, i] * (self.pair_bins + 1) + coarse[:, j]]
        return total


class QualityModel:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.share = float(y.mean()) if len(y) else 1.0
        self.model = AdditiveModel().fit(x, y) if len(np.unique(y)) == 2 else None

    def score(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for every text. Without two classes to learn from, the share of label 1 (1 without labels)."""
        if self.model is None:
            return np.full(len(texts), self.share)
        return sigmoid(self.model.margin(features(texts)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> QualityModel:
    """Learn `labels.quality` from at most `max_rows` labelled texts (see `training_rows`);
    the driver gets one row of features per training text."""
    training = written(training_rows(docs, labels, "quality", max_rows))
    return QualityModel(*training_features(training, features, len(FEATURES)))
