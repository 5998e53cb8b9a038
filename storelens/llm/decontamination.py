"""Benchmark passages in whole texts, within an edit budget.

By the q-gram lemma a stretch of text within k edits of a passage of m characters shares
m + 1 - q - k * q of its q-grams at least, all on diagonals at most k apart. Shared
q-grams are counted in overlapping bands of diagonals; bands that reach the bound are
verified by banded alignment. Short passages are looked for by shorter grams, so that the
bound is 1 at least with all their edits.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import POINT_SLICE, CodePoints, runs, slices, texts_of, worker_store

GRAM = 9  # the longest grams; passages whose budget needs it are looked for by shorter ones
EDIT_SHARE = 0.1
PASSAGE = 512  # longer items are looked for in pieces of this length
ALIGNED_AT_ONCE = 512
HITS_AT_ONCE = 2_000_000  # shared grams that a task holds at a time; it bounds memory, not results
CHECK_GRAM = 4  # of the second count, before the alignment
NONE = np.iinfo(np.int64).min
INDEX_CHARS = 4_000_000  # characters of passages that are looked for in one scan
FILTER_BITS = 22
MATCH = "item_id long, start long, end long, edits int"


def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case (where that is one character), and whether it is kept."""
    points = [chr(c) for c in range(sys.maxunicode + 1)]
    lower = np.fromiter((ord(w) if len(w := p.lower()) == 1 else ord(p) for p in points), np.uint32, len(points))
    return lower, np.fromiter(map(str.isalnum, points), bool, len(points))


class Folded:
    """Texts in lower-case letters and digits, any run of other characters as one blank.

    `at` is each kept symbol's place in its text; `starts` the first symbol of each text.
    """

    def __init__(self, texts: list[str]) -> None:
        lower, kept = worker_store("folding", _folding)
        points = CodePoints(texts)
        solid = kept[points.points]
        of_text = np.repeat(np.arange(len(texts)), np.diff(points.starts))
        blank = ~solid
        blank[1:] &= solid[:-1] & (of_text[1:] == of_text[:-1])
        blank[:1] = False  # and none before a text's first word
        shown = np.flatnonzero(solid | blank)
        self.symbols = np.where(solid, lower[points.points], 32)[shown].astype(np.uint32)
        self.of_text = of_text[shown]
        self.at = shown - points.starts[self.of_text]
        self.starts = np.searchsorted(self.of_text, np.arange(len(texts) + 1))

    def grams(self, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length q, ascending: q, hashes of all q-grams that lie within one text, and where they start."""
        hashed = np.zeros(len(self.symbols), np.uint64)
        for q in range(1, max(lengths, default=0) + 1):
            size = max(0, len(self.symbols) - q + 1)
            hashed = hashed[:size] * np.uint64(0x100000001B3) + self.symbols[q - 1 : q - 1 + size]
            if q in lengths:
                mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                places = np.flatnonzero(self.of_text[:size] == self.of_text[q - 1 : q - 1 + size])
                yield q, mixed[places], places


# ---- passages -------------------------------------------------------------------


class Grams:
    """The q-grams of the passages of one gram length: sorted hashes, whose they are and where."""

    def __init__(self, q: int, passages: np.ndarray, symbols: list[np.ndarray]) -> None:
        hashes, owners, places = [], [], []
        for k in passages:
            one = Folded.__new__(Folded)
            one.symbols, one.of_text = symbols[k], np.zeros(len(symbols[k]), np.int64)
            ((_, hashed, at),) = one.grams([q])
            hashes.append(hashed), owners.append(np.full(len(at), k)), places.append(at)
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hashes, self.owners, self.places = (np.concatenate(v)[order] for v in (hashes, owners, places))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def occurrences(self, hashed: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places whose gram some passage has, sorted by gram, and per entry of this index the
        first of its gram's places there and how many there are. Each distinct gram is looked up once."""
        maybe = np.flatnonzero(self.filter[hashed >> np.uint64(64 - FILTER_BITS)])
        order = maybe[np.argsort(hashed[maybe], kind="stable")]
        hashed = hashed[order]
        low = np.searchsorted(hashed, self.hashes, "left")
        return places[order], low, np.searchsorted(hashed, self.hashes, "right") - low


class Passages:
    """An index of passages: their symbols, edit budgets, bounds and q-grams.

    Each passage has grams of its own length: q, or the longest that its budget of k edits
    leaves a bound for, m // (k + 1).
    """

    def __init__(self, items: Sequence[tuple[int, str]], q: int = GRAM, share: float = EDIT_SHARE, passage: int = PASSAGE) -> None:
        folded = Folded([text for _, text in items])
        self.items: list[int] = []
        self.symbols: list[np.ndarray] = []
        for (item_id, _), a, b in zip(items, folded.starts[:-1], folded.starts[1:], strict=True):
            own = folded.symbols[a:b]
            while len(own) and own[-1] == 32:
                own = own[:-1]
            parts = max(1, len(own) // passage)
            for part in np.array_split(own, parts):
                if len(part):
                    self.items.append(item_id)
                    self.symbols.append(part)
        lengths = np.array([len(s) for s in self.symbols], np.int64)
        self.budget = np.where(lengths < q, 0, np.minimum((lengths * share).astype(np.int64), lengths - 1))
        gram = np.minimum(q, lengths // (self.budget + 1))
        self.bound = lengths + 1 - gram * (self.budget + 1)
        self.width = self.budget + 1
        self.grams_of = lengths + 1 - gram
        self.short = np.flatnonzero(lengths < q)
        long = np.flatnonzero(lengths >= q)
        self.grams = {int(size): Grams(int(size), long[gram[long] == size], self.symbols) for size in np.unique(gram[long])}

    def hits(self, folded: Folded) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in the texts, passage and place in it of every gram that both have, some passages at a time.

        A passage comes whole, and with others only as far as HITS_AT_ONCE allows. One that
        alone has more comes in parts, places of the texts in ascending order.
        """
        for q, hashed, places in folded.grams(list(self.grams)):
            grams = self.grams[q]
            found, low, count = grams.occurrences(hashed, places)
            used = np.flatnonzero(count)
            used = used[np.argsort(grams.owners[used], kind="stable")]
            owners = grams.owners[used]
            edges = np.append(np.flatnonzero(np.diff(owners, prepend=-1)), len(used))
            # A stretch has as many of the passage's own grams as the bound says.
            enough = np.diff(edges) >= self.bound[owners[edges[:-1]]]
            total = np.concatenate([[0], np.cumsum(count[used])])
            group: list[np.ndarray] = []
            size = 0
            for start, stop in zip(edges[:-1][enough].tolist(), edges[1:][enough].tolist(), strict=True):
                own = int(total[stop] - total[start])
                if group and size + own > HITS_AT_ONCE:
                    yield self._pairs(grams, found, low, count, np.concatenate(group))
                    group, size = [], 0
                if own <= HITS_AT_ONCE:
                    group.append(used[start:stop])
                    size += own
                else:
                    yield from self._in_parts(folded, grams, found, low, count, used[start:stop])
            if group:
                yield self._pairs(grams, found, low, count, np.concatenate(group))

    @staticmethod
    def _pairs(grams: Grams, found: np.ndarray, low: np.ndarray, count: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = count[entries]
        return found[runs(low[entries], n)], np.repeat(grams.owners[entries], n), np.repeat(grams.places[entries], n)

    def _in_parts(self, folded: Folded, grams: Grams, found: np.ndarray, low: np.ndarray, count: np.ndarray, entries: np.ndarray):
        """One passage with very many hits: bands of a part of the places at a time.

        Parts overlap by what a passage and its bands span, so each band is whole in one of
        them; that it may show in two makes its place known twice.
        """
        passage = int(grams.owners[entries[0]])
        reach = len(self.symbols[passage]) + 4 * int(self.width[passage])
        step = max(HITS_AT_ONCE // max(len(entries), 1), 2 * reach)
        for start in range(0, len(folded.symbols), step):
            left, right = start - reach, start + step + reach
            pairs = []
            for e in entries.tolist():
                own = found[low[e] : low[e] + count[e]]  # in ascending order, as the sort is stable
                a, b = np.searchsorted(own, [left, right])
                pairs.append((own[a:b], np.full(b - a, passage), np.full(b - a, grams.places[e])))
            places, owners, own_places = (np.concatenate(v) for v in zip(*pairs, strict=True))
            if len(places):
                yield places, owners, own_places

    def bands(self, folded: Folded, places: np.ndarray, passage: np.ndarray, own_places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, passage, first diagonal and lowest exact diagonal (or NONE) of every band of the hits
        that reaches its bound."""
        text = folded.of_text[places]
        # Diagonals start below 0 by a passage's length at most; shift them.
        diagonal = places - folded.starts[text] - own_places
        width = self.width[passage]
        band = np.floor_divide(diagonal, width)
        # Each diagonal lies in two bands, of twice the width, so no stretch is parted.
        low, high = int(band.min()) - 1, int(band.max())
        key = (text * len(self.items) + passage) * (high - low + 1) - low
        keys, counts = np.unique(np.concatenate([key + band, key + band - 1]), return_counts=True)
        owner, shift = np.divmod(keys, high - low + 1)
        text, passage_of = np.divmod(owner, len(self.items))
        good = counts >= self.bound[passage_of]
        keys, text, passage_of, first = keys[good], text[good], passage_of[good], (shift[good] + low) * self.width[passage_of[good]]
        # Where all of a passage's grams lie on one diagonal, it stands there as it is.
        least, most = int(diagonal.min()), int(diagonal.max())
        on, times = np.unique((folded.of_text[places] * len(self.items) + passage) * (most - least + 1) + diagonal - least, return_counts=True)
        owner, exact = np.divmod(on, most - least + 1)
        whole = times == self.grams_of[owner % len(self.items)]
        owner, exact = owner[whole], exact[whole] + least
        sorted_by = np.lexsort((exact, owner))
        owner, exact = owner[sorted_by], exact[sorted_by]
        line = owner * (most - least + 1) + exact - least
        mine = text * len(self.items) + passage_of
        at = np.searchsorted(line, mine * (most - least + 1) + np.clip(first - least, 0, most - least + 1))
        inside = at < len(line)
        inside[inside] = (owner[at[inside]] == mine[inside]) & (exact[at[inside]] < first[inside] + 2 * self.width[passage_of[inside]])
        return text, passage_of, first, np.where(inside, exact[np.minimum(at, max(len(exact) - 1, 0))] if len(exact) else NONE, NONE)

    def _stretches(self, folded: Folded) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, passage, start, end, edits) in symbols of the text, some of them more than once."""
        for hits in self.hits(folded):
            text, passage, first, exact = self.bands(folded, *hits)
            known = exact != NONE
            for t, p, d in zip(text[known].tolist(), passage[known].tolist(), exact[known].tolist(), strict=True):
                own = self.symbols[p]
                if np.array_equal(folded.symbols[folded.starts[t] + d : folded.starts[t] + d + len(own)], own):
                    yield t, p, d, d + len(own), 0
                else:
                    yield from self._aligned(folded, [(t, p, d // int(self.width[p]) * int(self.width[p]))])
            # Those of like length together, so that a batch is hardly padded.
            rest = np.flatnonzero(~known)
            rest = rest[np.argsort([len(self.symbols[p]) for p in passage[rest].tolist()], kind="stable")]
            for at in range(0, len(rest), ALIGNED_AT_ONCE):
                some = rest[at : at + ALIGNED_AT_ONCE]
                yield from self._aligned(folded, list(zip(text[some].tolist(), passage[some].tolist(), first[some].tolist(), strict=True)))

    def _aligned(self, folded: Folded, bands: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        places = [(folded.starts[text], folded.starts[text + 1], diagonal - self.budget[passage]) for text, passage, diagonal in bands]
        passages = [self.symbols[passage] for _, passage, _ in bands]
        width = [2 * int(self.width[passage] + self.budget[passage]) for _, passage, _ in bands]
        if max(map(len, passages)) >= CHECK_GRAM:
            budgets = self.budget[[passage for _, passage, _ in bands]]
            left = np.flatnonzero(plausible(passages, budgets, folded.symbols, places, max(width))).tolist()
            bands, places, passages, width = ([x[k] for k in left] for x in (bands, places, passages, width))
        if not bands:
            return
        for (text, passage, _), (first, last, low), (end, edits) in zip(
            bands, places, best_ends(passages, folded.symbols, places, width), strict=True
        ):
            end = min(low + end, last - first)
            if edits <= self.budget[passage] and end > 0:
                own = folded.symbols[first + max(0, low) : first + end]
                back = _last_row(self.symbols[passage][::-1], own[::-1])
                yield text, passage, int(end - back.argmin()), int(end), int(back.min())

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), best first for each item where stretches overlap."""
        folded = Folded(texts)
        found = set(self._stretches(folded))
        for passage in self.short:
            wanted = self.symbols[passage].tobytes()
            found |= {(text, int(passage), *stretch, 0) for text in range(len(texts)) for stretch in
                      _exact(folded.symbols[folded.starts[text] : folded.starts[text + 1]], wanted)}
        kept: list[tuple[int, int, int, int, int]] = []
        taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for text, passage, a, b, edits in sorted(found, key=lambda m: (m[0], m[1], m[4], m[2], m[3])):
            spans = taken.setdefault((text, passage), [])
            if all(b <= x or y <= a for x, y in spans):
                spans.append((a, b))
                places = folded.at[folded.starts[text] :]
                kept.append((text, self.items[passage], int(places[a]), int(places[b - 1]) + 1, edits))
        return kept


def _exact(symbols: np.ndarray, wanted: bytes) -> list[tuple[int, int]]:
    """Where the whole words of a short passage stand."""
    line = np.concatenate([[32], symbols, [32]]).astype(np.uint32).tobytes()
    wanted = np.uint32(32).tobytes() + wanted + np.uint32(32).tobytes()
    found, at = [], line.find(wanted)
    while at >= 0:
        if at % 4 == 0:
            found.append((at // 4, at // 4 + len(wanted) // 4 - 2))
        at = line.find(wanted, at + 1)
    return found


def _laid_out(passages: list[np.ndarray], symbols: np.ndarray, places: list[tuple[int, int, int]], band: int) -> tuple[np.ndarray, np.ndarray]:
    """A row per passage: its symbols, and those of the text from its lowest diagonal on; beyond
    both stand signs that equal no other."""
    n, longest = len(passages), max(map(len, passages))
    wanted = np.full((n, longest), 2**32 - 2, np.uint32)
    shown = np.full((n, longest + band), 2**32 - 1, np.uint32)
    for k, (passage, (first, last, low)) in enumerate(zip(passages, places, strict=True)):
        wanted[k, : len(passage)] = passage
        start, stop = max(0, low), min(last - first, low + len(passage) + band)
        if stop > start:
            shown[k, start - low : stop - low] = symbols[first + start : first + stop]
    return wanted, shown


def plausible(passages: list[np.ndarray], budgets: np.ndarray, symbols: np.ndarray, places: list[tuple[int, int, int]], band: int) -> np.ndarray:
    """Which passages keep enough of their short grams on the band's diagonals, by the lemma once more.

    Short grams leave a far higher bound, which chance does not reach; passages too short for
    one stay. Diagonals beyond a passage's own band only make the answer kinder.
    """
    wanted, shown = (
        (x[:, :-3] * np.uint32(0x9E3779B1) + x[:, 1:-2]) * np.uint32(0x85EBCA77) + (x[:, 2:-1] * np.uint32(0xC2B2AE3D) + x[:, 3:])
        for x in _laid_out(passages, symbols, places, band)
    )
    width = wanted.shape[1]
    matched = np.zeros(wanted.shape, bool)
    for diagonal in range(shown.shape[1] - width + 1):
        matched |= shown[:, diagonal : diagonal + width] == wanted
    lengths = np.array([len(p) for p in passages])
    matched &= np.arange(width) < (lengths - 3)[:, None]
    return matched.sum(axis=1) >= lengths + 1 - CHECK_GRAM * (budgets + 1)


def best_ends(
    passages: list[np.ndarray], symbols: np.ndarray, places: list[tuple[int, int, int]], band: int | list[int]
) -> list[tuple[int, int]]:
    """Banded alignment of many passages at once: where each ends best, and its edits there.

    A place is the first and last symbol of a text and the lowest diagonal of the band in
    it; the end counts from that diagonal. The passage may start on any diagonal of its own
    band (`band` has one width for all or one for each), whatever it is aligned with.
    Beyond the text stands a sign that equals no symbol.
    """
    n, longest = len(passages), max(map(len, passages))
    bands = np.broadcast_to(np.asarray(band), n)
    band = int(bands.max())
    # Diagonals beyond a passage's own band cost more than any alignment.
    beyond = np.where(np.arange(band) >= bands[:, None], np.int32(2**20 + longest), np.int32(0)).astype(np.int32)
    narrower = bool(beyond.any())
    wanted, shown = _laid_out(passages, symbols, places, band)
    steps = np.arange(band, dtype=np.int32)
    row = beyond.copy()
    lengths = np.array([len(p) for p in passages])
    result: list[tuple[int, int]] = [(0, 0)] * n
    for at in range(longest):
        new = row + (shown[:, at : at + band] != wanted[:, at : at + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if narrower:
            np.maximum(row, beyond, out=row)
        for k in np.flatnonzero(lengths == at + 1):
            offset = int(row[k].argmin())
            result[k] = (at + 1 + offset, int(row[k, offset]))
    return result


def _last_row(passage: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Edits between the passage and the stretch from its first symbol up to each place."""
    steps = np.arange(len(stretch) + 1)
    row = steps.copy()
    for symbol in passage:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (stretch != symbol), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


# ---- documents ------------------------------------------------------------------


def passage_blocks(benchmark: DataFrame, chars: int = INDEX_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, in the order of item_id; repeated rows once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def _matcher(block: list[tuple[int, str]], q: int, share: float):
    """A function of texts. A worker builds the index of the block it travels with, and keeps the last."""
    key = uuid.uuid4().hex

    def matches(texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        kept = worker_store("passages", dict)
        if key not in kept:
            kept.clear()
            kept[key] = Passages(block, q, share)
        return kept[key].matches(texts)

    return matches


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, share: float = EDIT_SHARE) -> DataFrame:
    """One row per place where a benchmark passage stands: doc_id and MATCH.

    Case and everything but letters and digits are ignored. A place may differ by `share`
    of the passage's characters, rounded down, whatever its length (at 10 %, those of fewer
    than 10 must match exactly); passages shorter than q must stand there exactly, as whole words.
    Items longer than PASSAGE are looked for in parts, each on its own. Places of one
    passage do not overlap. NULL, empty and blank texts and items have no place; repeated
    documents each have theirs; an empty table or benchmark gives no row.

    Texts stay where they are: no shuffle. Each block of the benchmark, bounded by
    INDEX_CHARS, is one scan.
    """
    found = None
    for block in passage_blocks(benchmark):
        matches = _matcher(block, q, share)

        def find(batches: Iterator[pa.RecordBatch], matches=matches) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, size=POINT_SLICE):
                rows = matches(texts_of(batch).to_pylist())
                text, item, start, end, edits = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(text, pa.int64())), pa.array(item, pa.int64()),
                    pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32()),
                ], names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(find, f"doc_id long, {MATCH}")
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], f"doc_id long, {MATCH}") if found is None else found


def clean_documents(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, share: float = EDIT_SHARE) -> DataFrame:
    """All columns of the rows that hold no passage (see `find_passages`)."""
    for block in passage_blocks(benchmark):
        matches = _matcher(block, q, share)

        def keep(batches: Iterator[pa.RecordBatch], matches=matches) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, size=POINT_SLICE):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(texts_of(batch).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
