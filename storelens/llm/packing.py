"""Documents packed into training sequences by cutting-stock column generation.

Full sequences are cut off long documents; what remains of each document is an item. A
linear program over the histogram of item lengths picks patterns (how many items of each
length class fill a sequence), a knapsack dynamic program prices new ones. Classes are
lengths rounded down, so a pattern of full size always fills its sequence; the few ids by
which its items run over join, with short items and those left by rounding, a stream that
is cut into sequences where it lies. Every sequence but the stream's last is full, and
that one is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.llm.common import new_folder, written
from storelens.llm.tokens import crc32_of, mapped, shard_writing, vocabulary_file

SEQUENCE = 2048
GRAIN = 16  # class width: the histogram has SEQUENCE / GRAIN classes, whatever the corpus
SHORTEST = 128  # shorter items go to the stream

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# ---- patterns -------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of items that fills the capacity: knapsack by dynamic programming.

    The price is -inf, and the multiset empty, if none fills it.
    """
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    taken = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            values = prices[fits] + best[room - sizes[fits]]
            best[room], taken[room] = values.max(), fits[values.argmax()]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0 and best[capacity] > -np.inf:
        counts[taken[room]] += 1
        room -= sizes[taken[room]]
    return float(best[capacity]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns (items per size) that fill a sequence and how often each is used.

    The linear program leaves as little as it can to the stream: a column is a full
    pattern, which costs nothing, or a single item left over, which costs its size. Its
    amounts are rounded down, so no size is used more often than demanded. `max_rounds`
    bounds the solver's time alone: stopping early leaves more to the stream.
    """
    if not len(sizes):
        return []
    basis, cost = np.eye(len(sizes)), sizes.astype(float)
    for _ in range(max_rounds):
        prices = np.linalg.solve(basis.T, cost)
        value, column = best_pattern(sizes, prices, capacity)
        price = 0.0
        over = int((prices - sizes).argmax())
        if prices[over] - sizes[over] > max(value, 1e-7):  # an item does better left over again
            value, price = prices[over] - sizes[over], float(sizes[over])
            column = np.eye(1, len(sizes), over, dtype=np.int64)[0]
        if value <= 1e-7:
            break
        amounts = np.linalg.solve(basis, demand)
        change = np.linalg.solve(basis, column)
        enters = np.flatnonzero(change > 1e-9)
        leaves = enters[(np.maximum(amounts[enters], 0) / change[enters]).argmin()]
        basis[:, leaves], cost[leaves] = column, price
    amounts = np.floor(np.linalg.solve(basis, demand) + 1e-7).astype(np.int64)
    columns = basis.round().astype(np.int64).T
    left, chosen = demand.astype(np.int64).copy(), []
    for column, amount, price in zip(columns, amounts, cost, strict=True):
        if price == 0:
            used = column > 0
            times = min(int(amount), int((left[used] // column[used]).min()))
            if times > 0:
                left -= times * column
                chosen.append((column, times))
    return chosen


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


# ---- packing --------------------------------------------------------------------


def tokenized(docs: DataFrame, folder: str, file: str | None = None) -> DataFrame:
    """Encode every text into its task's shard; one row per document says where its ids lie.

    Columns: shard, nth (the document's place there), ids_file, at (first id), doc_id, n.
    """

    def rows(batch: pa.RecordBatch, starts: np.ndarray, writer) -> pa.RecordBatch:
        size = batch.num_rows
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(size, writer.shard, np.int32)),
            pa.array(np.arange(writer.n_docs - size, writer.n_docs)),
            pa.array([writer.names[0]] * size),
            pa.array(starts[:-1]),
            batch.column("doc_id").cast(pa.int64()),
            pa.array(np.diff(starts)),
        ], names=["shard", "nth", "ids_file", "at", "doc_id", "n"])

    write = shard_writing(folder, file or vocabulary_file(), 2, rows)
    schema = "shard int, nth long, ids_file string, at long, doc_id long, n long"
    return written(docs.select("doc_id", "text").mapInArrow(write, schema))


def pack(docs: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN, shortest: int = SHORTEST, file: str | None = None) -> DataFrame:
    """One row per piece (PIECES); each id of each document lies in exactly one.

    NULL and empty texts are the end id alone. Rows of equal or NULL doc_id are documents
    of their own; columns but doc_id and text are ignored; an empty table gives no row.
    `grain` divides `sequence`, a power of two.

    Ranks within a length class and places in the stream come from sums per shard plus a
    window within the shard, so no class, however many documents share it, is sorted in
    one task. The driver gets the histogram and two sums per shard.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    items = (
        tokenized(docs, folder, file)
        .withColumn("full", F.expr(f"n div {sequence}"))
        .withColumn("rest", F.expr(f"n % {sequence}"))
        .withColumn("class", F.when(F.col("rest") >= shortest, F.expr(f"cast(rest div {grain} as int)")))
    )
    per_shard = items.where("class IS NOT NULL").groupBy("class", "shard").agg(F.count("*").alias("n_class"))
    histogram = {r["class"]: r["n"] for r in per_shard.groupBy("class").agg(F.sum("n_class").alias("n")).collect()}
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], float)
    capacity = sequence // grain
    uses, n_patterned = [], 0
    taken = dict.fromkeys(sizes.tolist(), 0)
    for column, times in patterns(sizes, demand, capacity):
        for size, each in zip(sizes.tolist(), column.tolist(), strict=True):
            if each:
                uses.append((size, taken[size], taken[size] + each * times, each, n_patterned))
                taken[size] += each * times
        n_patterned += times
    plan = spark.createDataFrame(uses, "class int, rank_from long, rank_to long, each int, first_sequence long")

    before = W.partitionBy("class").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = per_shard.select("class", "shard", F.coalesce(F.sum("n_class").over(before), F.lit(0)).alias("base"))
    ranked = (
        items.withColumn("own", F.row_number().over(W.partitionBy("shard", "class").orderBy("nth")))
        .join(bases, ["class", "shard"], "left")
        .withColumn("rank", F.col("base") + F.col("own") - 1)
    )
    # At most (sequence / grain) squared rows, whatever the corpus.
    in_range = (ranked["class"] == plan["class"]) & ranked["rank"].between(plan["rank_from"], plan["rank_to"] - 1)
    placed = (
        ranked.join(F.broadcast(plan), in_range, "left")
        .drop(plan["class"])
        .withColumn("pattern_sequence", F.expr("first_sequence + (rank - rank_from) div each"))
    )
    # Sequences have at most sequence / shortest items; items without one are not ordered.
    fill = W.partitionBy("pattern_sequence").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, -1)
    in_sequences = placed.where("pattern_sequence IS NOT NULL").withColumn("offset", F.coalesce(F.sum("rest").over(fill), F.lit(0)))
    others = placed.where("pattern_sequence IS NULL").withColumn("offset", F.lit(sequence).cast("long"))
    settled = written(
        in_sequences.unionByName(others)
        .withColumn("inside", F.expr(f"greatest(least(rest, {sequence} - offset), 0)"))
        .select("shard", "nth", "ids_file", "at", "doc_id", "n", "full", "rest", "pattern_sequence", "offset", "inside")
    )

    totals = settled.groupBy("shard").agg(F.sum("full").alias("full"), F.sum(F.col("rest") - F.col("inside")).alias("streamed")).collect()
    shard_bases, n_full, n_stream = [], 0, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        shard_bases.append((r["shard"], n_full, n_stream))
        n_full, n_stream = n_full + r["full"], n_stream + r["streamed"]
    bases = spark.createDataFrame(shard_bases, "shard int, full_base long, stream_base long")
    here = W.partitionBy("shard").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    ordered = (
        settled.join(bases, "shard")
        .withColumn("first_full", F.col("full_base") + F.coalesce(F.sum("full").over(here), F.lit(0)))
        .withColumn("place", F.col("stream_base") + F.coalesce(F.sum(F.col("rest") - F.col("inside")).over(here), F.lit(0)))
    )
    return _with_checksums(_pieces(ordered, sequence, n_full, n_patterned, n_stream), folder)


def _pieces(ordered: DataFrame, sequence: int, n_full: int, n_patterned: int, n_stream: int) -> DataFrame:
    whole = n_stream // sequence * sequence
    tail = [whole]
    for size in powers_of_two(n_stream - whole):
        tail.append(tail[-1] + size)
    tails = f"array({', '.join(f'{t}L' for t in tail)})"
    first_stream = n_full + n_patterned
    end = "place + rest - inside"
    # Where pieces of the stream start: at the item, at each sequence and at each part of the tail.
    cuts = (
        f"array_sort(array_distinct(concat(array(place), filter(transform(sequence(place div {sequence}, ({end}) div {sequence}), k -> k * {sequence}), "
        f"x -> x > place AND x < {end} AND x <= {whole}), filter({tails}, x -> x > place AND x < {end}))))"
    )
    streamed = f"""transform({cuts}, (x, k) -> named_struct(
        'start', full * {sequence} + inside + x - place,
        'length', coalesce(get(cuts, k + 1), {end}) - x,
        'sequence_id', {first_stream} + if(x < {whole}, x div {sequence}, {whole // sequence} + size(filter({tails}, t -> t <= x)) - 1),
        'offset', x - if(x < {whole}, x div {sequence} * {sequence}, array_max(filter({tails}, t -> t <= x)))))""".replace("get(cuts,", f"get({cuts},")
    none = "array()"
    return ordered.select(
        "shard", "ids_file", "at", "doc_id", F.col("n").alias("doc_tokens"),
        F.explode(F.expr(f"""concat(
            if(full > 0, transform(sequence(0L, greatest(full - 1, 0L)), k -> named_struct('start', k * {sequence}, 'length', {sequence}L,
                'sequence_id', first_full + k, 'offset', 0L)), {none}),
            if(inside > 0, array(named_struct('start', full * {sequence}, 'length', inside,
                'sequence_id', {n_full} + pattern_sequence, 'offset', offset)), {none}),
            if(rest > inside, {streamed}, {none}))""")).alias("piece"),
    ).select("shard", "ids_file", "at", "doc_id", "doc_tokens", "piece.*")


def _with_checksums(pieces: DataFrame, folder: str) -> DataFrame:
    """Each piece's ids, read from its shard. Rows come shard by shard, as the window left them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = "", np.zeros(0)
        for batch in batches:
            start, length = (batch.column(c).to_numpy() for c in ("start", "length"))
            first = batch.column("at").to_numpy() + start
            crcs = []
            for file, a, n in zip(batch.column("ids_file").to_pylist(), first.tolist(), length.tolist(), strict=True):
                if file != name:
                    name, ids = file, mapped(folder, file, "<u2")
                crcs.append(crc32_of(ids[a : a + n]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("length"), pa.array(crcs, pa.int64()),
                 batch.column("doc_tokens"), batch.column("sequence_id"), batch.column("offset")],
                names=[p.split()[0] for p in PIECES.split(", ")],
            )

    return pieces.mapInArrow(check, PIECES)
