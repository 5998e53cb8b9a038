"""Byte strings that start at several places of a corpus, removed: a blockwise suffix sort on a difference cover.

Places whose offset in their text is in a difference cover form a sample: two equal
strings of 400 bytes, wherever they start, have sample places at the same distance from
their starts, so 218 equal bytes follow there. The sample's suffixes are ranked once, on
those 218 bytes. Only a place with a repeated sample suffix ahead can start a repeated
string; all other suffixes are never sorted.

The suffixes that are left tie for long: stretches of them that a copy repeats are classed
first, each as one key, and a class keeps one member. Then single suffixes of what is
unclassed, and of the classes' members, are sorted on their 400 bytes. Each of the three
sorts goes by buckets, one at a time in a task; a bucket has a bounded share of the keys.
The order within a bucket is that of 64-bit keys of the bytes, not the bytes' own: only
equality is asked for, and a key has 8 bytes rather than 400 (4 in the sample's sort, which
only chooses what is sorted later).

Tasks send their keys in flights: the keys of some megabytes of texts, one row per bucket,
each key once per flight. So a string with a third of all places is a key per flight, and
what repeats within a flight is known there at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import runs, slices, texts_of

LENGTH = 400
# A perfect difference set; each distance modulo CYCLE is a difference of two members.
CYCLE = 183
COVER = (0, 1, 8, 24, 37, 41, 59, 107, 119, 128, 134, 139, 153, 181)
# Bytes after a sample place that two equal strings share at least.
SEED = LENGTH - CYCLE + 1
# Text hashed at a time, keys of a flight, and the mean length of a stretch.
PIECE = 1_500_000
FLIGHT = 1_500_000
STRETCH = 32
# Buckets per shuffle partition; a task sorts one after the other. A flight is a row per
# bucket, so more of them would make rows, not keys, the load.
BUCKETS_PER_PARTITION = 2

# Of a key's member: several places of its flight have the key; it is known to repeat and asks nothing.
_MANY, _PARTNER = 1, 2

CELL = "bucket int, flight binary, keys binary, places binary, flags binary, known binary, texts binary"
ANSWER = "flight binary, marks binary, reps binary, known binary, texts binary"
MARKS = "digest binary, marks binary, reps binary"


# ---- keys of strings ----------------------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray, first: int, second: int) -> np.ndarray:
    x = a * np.uint64(first)
    y = b ^ (b >> np.uint64(31))
    y *= np.uint64(second)
    x += y
    x ^= x >> np.uint64(32)
    return x


def _doubled(data: np.ndarray, to: int) -> np.ndarray:
    """A key of the `to` bytes (a power of two, 8 at least) from every place on."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.empty(n, np.uint64)
    for shift in range(min(8, n)):
        whole = (len(data) - shift) // 8
        key[shift::8] = data[shift : shift + 8 * whole].view(np.uint64)
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    width = 8
    while width < to:
        key = _mix(key[: max(len(key) - width, 0)], key[width:], 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
        width *= 2
    return key


def seed_keys(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    half = _doubled(data, 128)
    return _mix(half[places], half[places + SEED - 128], 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def string_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of the LENGTH bytes from every place on."""
    half = _doubled(data, 256)
    a, b = half[: max(len(half) - LENGTH + 256, 0)], half[LENGTH - 256 :]
    return _mix(a, b, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3), _mix(b, a, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


# ---- pieces of texts ------------------------------------------------------------------


class Pieces:
    """Some texts' bytes in one array, long texts in pieces that share LENGTH - 1 bytes.

    `row`, `base`: a piece's text in the batch and offset there. `start`, `own`, `size`:
    where it lies in `data`, how many places are its own, how many bytes it has.
    """

    def __init__(self, texts: list[bytes], cut: list[tuple[int, int]]) -> None:
        self.row = np.array([r for r, _ in cut], np.int64)
        self.base = np.array([b for _, b in cut], np.int64)
        parts = [texts[r][b : b + PIECE + LENGTH - 1] for r, b in cut]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.own = np.minimum(self.size, PIECE)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def places(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All own places in `data` that `width` bytes of the piece follow, and their pieces."""
        n = np.maximum(np.minimum(self.own, self.size - width + 1), 0)
        return runs(self.start, n), np.repeat(np.arange(len(n)), n)


def pieces(texts: list[bytes]) -> Iterator[Pieces]:
    """All pieces in order, about PIECE bytes at a time."""
    cut: list[tuple[int, int]] = []
    room = PIECE
    for r, text in enumerate(texts):
        for b in range(0, len(text), PIECE):
            cut.append((r, b))
            room -= min(len(text) - b, PIECE)
            if room <= 0:
                yield Pieces(texts, cut)
                cut, room = [], PIECE
    if cut:
        yield Pieces(texts, cut)


# ---- flights out, answers back ---------------------------------------------------------


class Flight:
    """Keys of successive pieces until they are sent; a place of a flight is one of its pieces' own
    places, counted on from piece to piece."""

    def __init__(self, buckets: int, key_type: type) -> None:
        self.buckets, self.key_type = buckets, key_type
        self.clear()

    def clear(self) -> None:
        self.size = self.keys_held = 0
        self.digests: list[bytes] = []
        self.starts: list[int] = []
        self.bases: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.known: list[np.ndarray] = []

    def add_pieces(self, own: Pieces, digests: list[bytes]) -> np.ndarray:
        """Where each piece begins among the flight's places."""
        begin = self.size + np.cumsum(own.own) - own.own
        self.digests += [digests[r] for r in own.row.tolist()]
        self.starts += begin.tolist()
        self.bases += own.base.tolist()
        self.size += int(own.own.sum())
        return begin

    def add_keys(self, keys: np.ndarray, buckets: np.ndarray, places: np.ndarray, asks: np.ndarray | None = None) -> None:
        flags = np.zeros(len(keys), np.uint8) if asks is None else np.where(asks, 0, _PARTNER).astype(np.uint8)
        self.parts.append((keys, buckets, places, flags))
        self.keys_held += len(keys)

    def full(self) -> bool:
        return self.keys_held >= FLIGHT

    def sent(self) -> Iterator[pa.RecordBatch]:
        """The cells of all buckets and the flight's directory; then the flight is empty.

        Members of a key that several places of the flight have are known to repeat; the key
        goes out with the first of them.
        """
        if not self.digests:
            return
        kinds = (self.key_type, np.uint32, np.int64, np.uint8)
        key, bucket, place, flags = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, t)]) for k, t in enumerate(kinds))
        order = np.lexsort((key, bucket))
        new = np.ones(len(key), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (bucket[order[1:]] != bucket[order[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        member = order[np.repeat(count > 1, count)]
        member = place[member[flags[member] == 0]]
        starts = np.array(self.starts, np.int64)
        known = merged(np.concatenate([*self.known, np.stack([member, member + 1], axis=1)]), starts)
        chosen = order[first]
        flags[chosen[count > 1]] |= _MANY
        chosen = chosen[np.lexsort((place[chosen], bucket[chosen]))]
        key, bucket, place, flags = key[chosen], bucket[chosen], place[chosen], flags[chosen]
        flight = self.digests[0] + self.bases[0].to_bytes(8, "little")
        edges = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(key)] if len(key) else []
        cells = [
            (int(bucket[a]), flight, key[a:b].tobytes(), written_places(place[a:b]), np.packbits(np.stack([flags[a:b] & _MANY, flags[a:b] >> 1])).tobytes(), None, None)
            for a, b in zip(edges, edges[1:], strict=False)
        ]
        directory = b"".join(self.digests) + np.stack([starts, np.array(self.bases, np.int64)]).tobytes()
        cells.append((int.from_bytes(flight[:4], "little") % self.buckets, flight, None, None, None, known.tobytes(), directory))
        kinds = [pa.int32(), *[pa.binary()] * 6]
        names = [c.split()[0] for c in CELL.split(", ")]
        for at in range(0, len(cells), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells[at : at + 256], strict=True), kinds, strict=True)], names=names)
        self.clear()


def written_places(places: np.ndarray) -> bytes:
    """Rising places as 16-bit steps; the highest value is a step that ends at no place."""
    steps = np.diff(places, prepend=0)
    far = steps // 65535
    out = np.full(len(places) + int(far.sum()), 65535, np.uint16)
    out[np.cumsum(far + 1) - 1] = steps % 65535
    return out.tobytes()


def read_places(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The rows' binary values in one array, and how many each row has."""
    values = [v or b"" for v in column.to_pylist()]
    return np.frombuffer(b"".join(values), kind), np.array([len(v) // np.dtype(kind).itemsize for v in values], np.int64)


def answered(cells: DataFrame, key_type: type = np.uint64, classes: bool = False) -> DataFrame:
    """Per flight and bucket, the members whose key stands elsewhere too.

    `reps` holds one member of each key that several have, if `classes`; the first by flight,
    so that a task that runs again says the same.
    """

    def answer(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("flight")
        flights = bucket.column("flight").to_pylist()
        key, n = _joined(bucket.column("keys"), key_type)
        place = np.concatenate([read_places(p or b"") for p in bucket.column("places").to_pylist()])
        bits = [np.unpackbits(np.frombuffer(f or b"", np.uint8), count=2 * k).reshape(2, k) for f, k in zip(bucket.column("flags").to_pylist(), n.tolist(), strict=True)]
        many, partner = np.concatenate(bits, axis=1).astype(bool)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        repeated = np.zeros(len(key), bool)
        repeated[order] = np.repeat(count > 1, count)
        marked = np.flatnonzero(repeated & ~many & ~partner)
        chosen = order[first]
        chosen = np.sort(chosen[repeated[chosen] | many[chosen]]) if classes else chosen[:0]
        known, texts = bucket.column("known").to_pylist(), bucket.column("texts").to_pylist()
        mark_at, rep_at = (np.searchsorted(row[x], np.arange(len(n) + 1)) for x in (marked, chosen))
        marks, reps = place[marked], place[chosen]
        out = [
            (flights[k], written_places(marks[mark_at[k] : mark_at[k + 1]]), written_places(reps[rep_at[k] : rep_at[k + 1]]), known[k], texts[k])
            for k in range(len(n)) if mark_at[k + 1] > mark_at[k] or rep_at[k + 1] > rep_at[k] or texts[k] is not None
        ]
        return pa.table([pa.array(c, pa.binary()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 5, names=[c.split()[0] for c in ANSWER.split(", ")])

    def deliver(flight: pa.Table) -> pa.Table:
        texts = next(t for t in flight.column("texts").to_pylist() if t is not None)
        known = next(t for t in flight.column("known").to_pylist() if t is not None)
        pieces_ = len(texts) // 32
        starts, bases = np.frombuffer(texts[16 * pieces_ :], np.int64).reshape(2, pieces_)
        mark, rep = (np.concatenate([read_places(p or b"") for p in flight.column(c).to_pylist()]) for c in ("marks", "reps"))
        spans = merged(np.concatenate([np.frombuffer(known, np.int64).reshape(-1, 2), np.stack([mark, mark + 1], axis=1)]), starts)
        of, rep = np.searchsorted(starts, spans[:, 0], side="right") - 1, np.sort(rep)
        of_rep = np.searchsorted(starts, rep, side="right") - 1
        out = []
        for k in np.union1d(of, of_rep).tolist():
            shift = bases[k] - starts[k]
            a, b = np.searchsorted(of, [k, k + 1])
            c, d = np.searchsorted(of_rep, [k, k + 1])
            out.append((texts[16 * k : 16 * k + 16], (spans[a:b] + shift).tobytes(), (rep[c:d] + shift).tobytes()))
        return pa.table([pa.array(c, pa.binary()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 3, names=["digest", "marks", "reps"])

    return (
        cells.groupBy("bucket").applyInArrow(answer, ANSWER)
        .groupBy("flight").applyInArrow(deliver, MARKS)
        .groupBy("digest").agg(F.collect_list("marks").alias("marks"), F.collect_list("reps").alias("reps"))
    )


def merged(spans: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Touching and overlapping spans (start, end) as one, in order; none passes a piece's start."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    if starts is not None:
        piece = np.searchsorted(starts, spans[:, 0], side="right")
        new[1:] |= piece[1:] != piece[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], end[np.concatenate([first[1:] - 1, [len(spans) - 1]])]], axis=1)


# ---- the three sorts -------------------------------------------------------------------

_IN_COVER = np.zeros(CYCLE, bool)
_IN_COVER[list(COVER)] = True
# A place in the batch's texts: row and offset in one number.
_ROW = 40


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)


def _expanded(rows: list[list[bytes] | None]) -> np.ndarray:
    """All places of the rows' spans, as numbers of row and offset in order."""
    out = [np.zeros(0, np.int64)]
    for row, spans in enumerate(rows):
        if spans:
            span = merged(np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2))
            out.append((row << _ROW) + runs(span[:, 0], span[:, 1] - span[:, 0]))
    return np.concatenate(out)


def _among(places: np.ndarray, rows: list[list[bytes] | None]) -> np.ndarray:
    out = [(row << _ROW) + np.frombuffer(b"".join(p), np.int64) for row, p in enumerate(rows) if p]
    return np.isin(places, np.concatenate(out)) if out else np.zeros(len(places), bool)


def _ahead(own: Pieces, live: np.ndarray) -> np.ndarray:
    """For each byte of the pieces, whether a repeated sample suffix begins at most CYCLE - 1 bytes on."""
    begin = (own.row << _ROW) + own.base
    low, high = np.searchsorted(live, begin), np.searchsorted(live, begin + own.own + CYCLE - 1)
    piece = np.repeat(np.arange(len(low)), high - low)
    at = live[runs(low, high - low)] - begin[piece]
    edges = np.zeros(len(own.data) + 1, np.int32)
    np.add.at(edges, own.start[piece] + np.maximum(at - CYCLE + 1, 0), 1)
    np.add.at(edges, own.start[piece] + np.minimum(at + 1, own.own[piece]), -1)
    return np.cumsum(edges) > 0


class Stretches:
    """Runs of places with a repeated sample suffix ahead, cut where their keys say, so that
    copies are cut alike. `place`, `piece` and keys `a`, `b` are by place; `first`, `size` by stretch."""

    def __init__(self, own: Pieces, live: np.ndarray) -> None:
        place, piece = own.places(LENGTH)
        kept = _ahead(own, live)[place]
        self.place, self.piece = place[kept], piece[kept]
        a, b = string_keys(own.data)
        self.a, self.b = a[self.place], b[self.place]
        cut = self.a % np.uint64(STRETCH) == 0
        cut[1:] |= (self.place[1:] != self.place[:-1] + 1) | (self.piece[1:] != self.piece[:-1])
        cut[:1] = True
        self.first = np.flatnonzero(cut)
        self.size = np.diff(np.append(self.first, len(cut)))
        self.of_row = (own.row[self.piece] << _ROW) + own.base[self.piece] + self.place - own.start[self.piece]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two keys of each stretch: of its strings in their order."""
        if not len(self.first):
            return self.a, self.b
        nth = (runs(np.zeros(len(self.size), np.int64), self.size) + 1).astype(np.uint64)
        mixed = (_mix(x, nth, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25) for x in (self.a, self.b))
        a, b = (np.add.reduceat(x, self.first) for x in mixed)
        return a, b


def _cells(texts: DataFrame, step: str, buckets: int) -> DataFrame:
    """The keys of one sort over `texts` (digest, text and what the sorts before found), as cells.

    Texts come by digest, so a task that runs again makes the same flights.
    """

    def add(own: Pieces, digests: list[bytes], found: dict[str, list], live: np.ndarray, flight: Flight) -> None:
        begin = flight.add_pieces(own, digests)
        if step == "sample":
            place, piece = own.places(SEED)
            chosen = _IN_COVER[(own.base[piece] + place - own.start[piece]) % CYCLE]
            place, piece = place[chosen], piece[chosen]
            key = seed_keys(own.data, place)
            flight.add_keys(key.astype(np.uint32), _bucket(key, buckets), begin[piece] + place - own.start[piece])
            return
        s = Stretches(own, live)
        ref = begin[s.piece] + s.place - own.start[s.piece]
        if step == "stretches":
            a, b = s.keys()
            flight.add_keys(a, _bucket(b, buckets), ref[s.first])
            return
        starts = s.of_row[s.first]
        settled = np.isin(starts, found["settled"])
        flight.known.append(np.stack([ref[s.first], ref[s.first] + s.size], axis=1)[settled])
        partner = settled & _among(starts, found["reps"])
        asks = np.repeat(~settled, s.size)
        sent = asks | np.repeat(partner, s.size)
        flight.add_keys(s.a[sent], _bucket(s.b[sent], buckets), ref[sent], asks[sent])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight = Flight(buckets, np.uint32 if step == "sample" else np.uint64)
        for batch in slices(batches):
            digests = batch.column("digest").to_pylist()
            found = {c: batch.column(c).to_pylist() for c in ("live", "settled", "reps") if c in batch.schema.names}
            live = _expanded(found.get("live", []))
            if "settled" in found:
                found["settled"] = _expanded(found["settled"])
            for own in pieces(texts_of(batch).cast(pa.large_binary()).to_pylist()):
                add(own, digests, found, live, flight)
                if flight.full():
                    yield from flight.sent()
        yield from flight.sent()

    return texts.sortWithinPartitions("digest").mapInArrow(run, CELL)


def without(text: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, removed stretches and what is left, if all strings that start in `spans` go."""
    spans = merged(np.stack([spans[:, 0], spans[:, 1] + LENGTH - 1], axis=1))
    edges = [0, *spans.ravel().tolist(), len(text)]
    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return len(text) - len(left), len(spans), left


def digest(text: Column) -> Column:
    """What texts are told apart by: 128 bits of the whole text; NULL is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def changed_texts(docs: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept) of each distinct text of `docs` that loses bytes.

    A text that stands in several rows is a repeated string as a whole, if it has LENGTH
    bytes; its first row still takes part once in the sorts. `kept` is binary, as a cut may
    part the bytes of a character. Shorter and NULL texts lose nothing.

    The texts are shuffled once, by digest; each sort reads that shuffle again and joins
    what the sorts before found. Everything is one plan, so a lost executor's part is made
    again from the shuffle's inputs.
    """
    keyed = docs.select(digest(F.col("text")).alias("digest"), "text").where(F.octet_length("text") >= LENGTH)
    # Joins would add this condition below some uses only, and unequal plans share no shuffle.
    keyed = keyed.where(F.col("digest").isNotNull())
    texts = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    live = answered(_cells(texts, "sample", buckets), np.uint32).select("digest", F.col("marks").alias("live"))
    ahead = texts.join(live, "digest")
    stretches = answered(_cells(ahead, "stretches", buckets), classes=True).select("digest", F.col("marks").alias("settled"), "reps")
    starts = answered(_cells(ahead.join(stretches, "digest", "left"), "strings", buckets)).select("digest", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for name, text, marks in zip(batch.column("digest").to_pylist(), texts_of(batch).cast(pa.large_binary()).to_pylist(), batch.column("marks").to_pylist(), strict=True):
                out.append((name, *without(text, merged(np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)))))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["digest", "n_removed", "n_spans", "kept"])

    changed = texts.join(starts, "digest").mapInArrow(cut, "digest binary, n_removed long, n_spans long, kept binary")
    copied = keyed.select("digest", F.octet_length("text").cast("long").alias("n")).groupBy("digest", "n").count().where(F.col("count") > 1)
    whole = copied.select("digest", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return changed.join(copied, "digest", "left_anti").unionByName(whole)


def remove_repeats(docs: DataFrame, *kept: str) -> DataFrame:
    """`kept` columns of every row with n_bytes, n_removed, n_spans and `left`, the bytes that stay.

    Every byte goes that a LENGTH-byte string covers which also starts at another place of
    any text, the same one included; matches do not cross texts. A NULL text is empty,
    repeated rows are all kept, an empty table gives no rows, and other columns, whatever
    their names, are left out.
    """
    rows = docs.select(F.struct(*kept).alias("row"), "text", digest(F.col("text")).alias("digest"))
    own = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.join(changed_texts(docs), "digest", "left").select(
        "row.*", F.octet_length(own).cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", own).alias("left"),
    )
