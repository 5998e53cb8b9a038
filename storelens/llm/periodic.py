"""Periodic runs of words: Lyndon arrays under both orders, roots extended to runs.

A run is a stretch of words with smallest period q that no neighbouring word extends.
Every run has Lyndon words of length q as its roots, and the longest Lyndon word that
begins at such a root is the root itself, under the order or under its reverse. Both
Lyndon arrays come from the grouping phase of Baier's suffix sorter alone; no suffix
array is built. A root is then extended to both sides as far as words q apart agree.

Only stretches that may hold a run are grouped: within a run of period q, each three
words stand again at most q words later, and that 3q - 2 times in a row. This is
necessary for every run, whatever the text, and is tested for all periods at once in
powers of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storelens.llm.common import Words, slices, texts_of

# A run counts from this many words and this many periods.
MIN_WORDS = 6
MIN_PERIODS = 4

RESULT = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place, by groups of suffixes.

    Groups hold suffixes that share a Lyndon prefix and stand in the order of those
    prefixes. They are taken from the greatest down; a taken group's prefix is final.
    A member's predecessor is the nearest place before it that is not taken. Its prefix
    grows by the taken group's prefix, once per member it precedes, so it moves to a new
    group directly above its own; more repetitions stand higher. Every place is taken once
    and moves one predecessor at most, so there are n moves in all.
    """
    n = len(ranks)
    members: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    group = list(ranks)
    length = [1] * len(members)
    down = list(range(-1, len(members) - 1))
    up = list(range(1, len(members) + 1))
    taken = bytearray(n)
    before = [-1] * n
    lyndon = [1] * n
    current = len(members) - 1
    while current >= 0:
        own = sorted(i for i in members[current] if group[i] == current)
        members[current] = []
        size = length[current]
        for i in own:
            taken[i] = 1
            lyndon[i] = size
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and taken[p]:
                p = before[p]
            # Shorten the way for those who come later.
            q = i - 1
            while q > p:
                q, before[q] = before[q], p
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moved.setdefault((group[p], k), []).append(p)
        last: dict[int, int] = {}
        for old, k in sorted(moved):
            under, new = last.get(old, old), len(members)
            over = up[under]
            members.append(moved[old, k])
            length.append(length[old] + k * size)
            down.append(under)
            up.append(over)
            up[under] = down[over] = new
            last[old] = new
            for p in members[new]:
                group[p] = new
        current = down[current]
    return lyndon


def common_length(codes: np.ndarray, i: int, j: int, step: int) -> int:
    """How many codes agree from places i and j (i < j) on, forwards (step 1) or backwards (-1)."""
    total, block = 0, 16
    while True:
        left = len(codes) - j if step > 0 else i + 1
        width = min(block, left)
        if width <= 0:
            return total
        a = codes[i : i + width] if step > 0 else codes[i - width + 1 : i + 1][::-1]
        b = codes[j : j + width] if step > 0 else codes[j - width + 1 : j + 1][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return total + int(differ[0])
        total, i, j, block = total + width, i + step * width, j + step * width, 2 * block


def runs_of(codes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period.

    A run of four periods holds three roots in a row that are longest Lyndon words, so
    only such places are extended, and none that a run already found explains.
    """
    n = len(codes)
    _, ranks = np.unique(codes, return_inverse=True)
    found: set[tuple[int, int, int]] = set()
    for order in (ranks, ranks.max(initial=0) - ranks):
        root = np.array(lyndon_lengths(order.tolist()), np.int64)
        places = np.arange(n)
        for k in range(1, min_periods - 1):  # the next root begins where this one ends, and so on
            places = places[places + k * root[places] < n]
            following = places + k * root[places]
            places = places[(codes[following] == codes[places]) & (root[following] == root[places])]
        covered: dict[int, int] = {}  # per period, where the last run found ends
        for i in places.tolist():
            q = int(root[i])
            if i + q <= covered.get(q, -1):
                continue
            start = i - common_length(codes, i - 1, i + q - 1, -1)
            end = i + q + common_length(codes, i, i + q, 1)
            covered[q] = end
            if end - start >= max(min_words, min_periods * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, starts: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all stretches of words outside which no run can lie.

    `starts` are the texts' first words, with the end of the last. For periods from 2^k to
    2^(k+1), three words that begin a period or more before a run's end must stand again
    fewer than 2^(k+1) words later. Equal hashes of different words only add stretches.
    """
    n = len(codes)
    sizes = np.diff(starts)
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = codes.astype(np.uint64) + np.uint64(1)
    three = key[:-2] * np.uint64(0x9E3779B97F4A7C15)
    three ^= three >> np.uint64(29)
    three = (three + key[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)
    three ^= three >> np.uint64(32)
    three = (three + key[2:]) * np.uint64(0x94D049BB133111EB)
    three ^= three >> np.uint64(29)
    three = (three + text[:-2].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.flatnonzero(text[:-2] == text[2:])
    order = inside[np.argsort(three[inside], kind="stable")]
    again = three[order[1:]] == three[order[:-1]]
    gap = np.full(n, n + 1, np.int64)
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    ends_of_text = starts[1:]
    period = 1
    while min_periods * period <= sizes.max(initial=0):
        near = gap < 2 * period
        edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= max(max(min_words, min_periods * period) - period - 2, 1)
        begin, end = begin[long], end[long]
        # The last three words' next place, and one word more; a text's end cuts.
        end = np.minimum(end + 2 * period + 1, ends_of_text[text[begin]] if len(begin) else end)
        found.append((begin, end))
        period *= 2
    begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    if not len(begin):
        return begin, end
    # A text's last two words begin no three, so no stretch passes from text to text.
    first = np.flatnonzero(np.concatenate([[True], begin[1:] >= end[:-1]]))
    return begin[first], end[np.concatenate([first[1:] - 1, [len(begin) - 1]])]


def batch_runs(words: Words) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by text, for the texts of a batch that have any; places count from the text's first word."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    begin, end = stretches(words.codes, words.starts)
    text = np.searchsorted(words.starts, begin, side="right") - 1
    for b, e, t in zip(begin.tolist(), end.tolist(), text.tolist(), strict=True):
        at = b - int(words.starts[t])
        if own := [(at + s, size, q) for s, size, q in runs_of(words.codes[b:e])]:
            found.setdefault(t, []).extend(own)
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a blank."""
    kept = np.ones(len(words), bool)
    for start, size, period in runs:
        kept[start + period : start + size] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def collapse_runs(docs: DataFrame, *kept: str, texts: Callable[[pa.RecordBatch], pa.Array] = texts_of) -> DataFrame:
    """`kept` columns, all runs of a text's words and the text without their repetitions.

    Words are parted by ASCII white space. `texts` gives the texts of a batch of `docs`.
    A NULL, empty or blank text has no runs and collapses to the empty text; repeated rows
    are all kept; other columns, whatever their names, are left out unless `texts` needs
    them, which it finds among `kept`. A text of any length is worked on as a whole, with
    some 300 bytes per word of a stretch that may hold runs. No row needs another one, so
    nothing is shuffled.
    """
    names = [docs.schema[k].simpleString().replace(":", " ", 1) for k in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = texts(batch).cast(pa.large_string())
            found = batch_runs(Words(own))
            plain = [b" ".join(t.split()) for t in own.cast(pa.large_binary()).to_pylist()]
            for k, runs in found.items():
                plain[k] = collapsed(plain[k].split(b" "), runs)
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(k, ())] for k in range(len(plain))]
            out = pa.array(plain, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(listed, _RUNS), out], names=[*kept, "runs", "collapsed"]
            )

    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*names, RESULT]))
