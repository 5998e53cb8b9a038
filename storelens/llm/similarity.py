"""Near-duplicate texts: MinHash LSH in fixed bands, then exact Jaccard similarity of word 5-grams.

Each band gives a text a label of MinHash values, as many as find a pair at the threshold
with the target probability; the number follows from the recall formula, not from the data,
so this is not an LSH forest. Texts that share a label, directly or through others, form a
group; within a group every pair is compared exactly, block by block, so that the work on a
group grows with the square of its different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.llm.common import Words, runs, slices, texts_of, written
from storelens.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
LEVELS = 8
RECALL = 0.999
SEED = 20_240_601
# Blocks of a group that one task compares: they bound its memory, not the group.
BLOCK_TEXTS = 2_048
BLOCK_SHINGLES = 2_000_000
COLUMNS = 4_096  # shingles of two blocks multiplied at once
FIRST_MADE_ID = 2**62  # rows of NULL doc_id get ids of their text from here on


def recall_at(depth: int, trees: int, similarity: float) -> float:
    """Chance that two texts of this similarity share a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(trees: int = TREES, levels: int = LEVELS, similarity: float = THRESHOLD, target: float = RECALL) -> int:
    """The most values a label may have to reach the target, by the formula alone."""
    depth = levels
    while depth > 1 and recall_at(depth, trees, similarity) < target:
        depth -= 1
    return depth


# ---- shingles and labels --------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingled:
    """64-bit hashes of the word n-grams of a batch of texts, and a digest of each text's words.

    Words are cut at white space and compared in lower case. A text of fewer words than
    an n-gram has one shingle of them all; one without words has none.
    """

    def __init__(self, texts: pa.Array, size: int = SHINGLE) -> None:
        import xxhash

        words = Words(texts)
        own = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words.words), np.uint64, len(words.words))
        hashes = own[words.codes]
        n = words.counts()
        starts = words.starts[:-1]
        self.digests = [hashlib.md5(hashes[a : a + k].tobytes()).digest() for a, k in zip(starts.tolist(), n.tolist(), strict=True)]
        self.counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        # Every place takes the next `size` words; a short text's end where it ends.
        rolled = np.zeros(len(hashes), np.uint64)
        ends = np.repeat(starts + n, n)
        at = np.arange(len(hashes))
        for k in range(size):
            following = np.minimum(at + k, len(hashes) - 1)
            value = np.where(at + k < ends, hashes[following], np.uint64(0)) if len(hashes) else hashes
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + value
        self.hashes = _mixed(rolled)[runs(starts, self.counts)]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def labels(self, trees: int, levels: int) -> np.ndarray:
        """A label per text and tree: `levels` MinHash values of 8 bits, the first on top."""
        chance = np.random.default_rng(SEED)
        keys = chance.integers(0, 2**32, (trees, LEVELS, 2), dtype=np.uint32) | np.array([0, 1], np.uint32)
        filled = np.flatnonzero(self.counts)
        labels = np.zeros((trees, len(self.counts)), np.uint64)
        if not len(filled):
            return labels
        low = (self.hashes >> np.uint64(32)).astype(np.uint32)
        firsts = self.starts[:-1][filled]
        for tree in range(trees):
            for level in range(levels):
                flip, factor = keys[tree, level]
                least = np.minimum.reduceat((low ^ flip) * factor, firsts)
                # The value's own bits are small numbers; mix them before keeping 8.
                value = _mixed(least.astype(np.uint64) + np.uint64(level + 1)) >> np.uint64(56)
                labels[tree, filled] |= value << np.uint64(8 * (7 - level))
        return labels


def signed(docs: DataFrame, trees: int, levels: int, shingle: int) -> DataFrame:
    """doc_id, own, hi and lo (the digest of its words), n_shingles and labels of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = Shingled(texts_of(batch), shingle)
            halves = np.frombuffer(b"".join(made.digests), "<i8").reshape(-1, 2)
            flat = pa.array(made.labels(trees, levels).T.astype(np.int64).ravel() if batch.num_rows else [], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, trees, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("own"), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(made.counts.astype(np.int64)), lists],
                names=["doc_id", "own", "hi", "lo", "n_shingles", "labels"],
            )

    return docs.mapInArrow(sign, "doc_id long, own long, hi long, lo long, n_shingles long, labels array<long>")


# ---- exact comparison -----------------------------------------------------------


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of `a` shares with each of `b` (or of `a`); sets are distinct hashes."""
    sets = a if b is None else [*a, *b]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    lengths = np.diff(np.append(first, len(flat)))
    often = lengths > 1  # a shingle of one set is shared with none
    column = np.repeat(np.cumsum(often) - 1, lengths)
    kept = np.repeat(often, lengths)
    column, owner = column[kept], owner[kept]
    n = len(a)
    total = np.zeros((n, n if b is None else len(b)), np.float32)
    for at in range(0, int(often.sum()), COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), int(min(COLUMNS, often.sum() - at))), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        total += part[:n] @ (part.T if b is None else part[n:].T)
    return total


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; a set is not paired with itself."""
    size_a = np.array([len(s) for s in a], float)
    size_b = size_a if b is None else np.array([len(s) for s in b], float)
    shared = shared_counts(a, b)
    joined = shared >= threshold * (size_a[:, None] + size_b[None, :] - shared) - 1e-6
    joined &= shared > 0
    if b is None:
        np.fill_diagonal(joined, False)
    return joined


def smallest_reached(joined: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation, the smallest row connected to it."""
    labels = np.arange(len(joined), dtype=np.int32)
    while True:
        near = np.where(joined, labels[None, :], np.int32(len(joined))).min(axis=1, initial=len(joined))
        new = np.minimum(labels, near)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _compare(group: list[tuple[int, int, np.ndarray]], alone: bool, threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Nodes, their links and the smallest node they connect to, within a block or between two.

    Rows are (node, block, shingles); two blocks are compared with each other only, so
    where one of them has no text there is nothing to compare."""
    known: dict[tuple[int, bytes], tuple[int, int, np.ndarray]] = {}
    for row in group:
        known.setdefault((row[0], row[2].tobytes()), row)
    rows = sorted(known.values(), key=lambda r: (r[1], r[0]))
    blocks = sorted({r[1] for r in rows})
    nodes = np.array([r[0] for r in rows], np.int64)
    if not alone and len(blocks) == 1:
        return [], [], []
    if alone:
        joined = linked([r[2] for r in rows], None, threshold)
    else:
        n = sum(r[1] == blocks[0] for r in rows)
        across = linked([r[2] for r in rows[:n]], [r[2] for r in rows[n:]], threshold)
        joined = np.zeros((len(rows), len(rows)), bool)
        joined[:n, n:], joined[n:, :n] = across, across.T
    joined &= nodes[:, None] != nodes[None, :]
    links = joined.sum(axis=1)
    kept = np.flatnonzero(links)
    # Rows are sorted by block first, so the least row need not be the least node; any will do.
    return nodes[kept].tolist(), links[kept].tolist(), nodes[smallest_reached(joined)[kept]].tolist()


def _verified(shingles: DataFrame, threshold: float) -> DataFrame:
    """(node, links, near) of every node that is linked within a pair of blocks."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(group):
            nodes, links, near = _compare(group, last[1] == last[2], threshold)
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(near, pa.int64())], names=["node", "links", "near"])

        last, group = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "low", "high")), strict=True))
            columns = zip(keys, batch.column("node").to_pylist(), batch.column("block").to_pylist(), batch.column("shingles"), strict=True)
            for key, node, block, packed in columns:
                if key != last:
                    if len(group) > 1:
                        yield result(group)
                    last, group = key, []
                group.append((node, block, np.frombuffer(packed.as_py(), "<u8")))
        if len(group) > 1:
            yield result(group)

    ordered = shingles.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
    return ordered.mapInArrow(verify, "node long, links long, near long")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL
) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_links, n_copies, class_text.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams reaches
    the threshold; a class is what links connect, named by its smallest doc_id. n_links
    counts the different texts that a text is linked to, n_copies the rows with its very
    words, itself included. Links are exact; one at the threshold is found with
    probability `recall` at least, a higher one more surely.

    Texts without words (NULL, empty, blank) are linked to nothing and make classes of
    their own, those of one doc_id one. Rows that share a doc_id fall into one class only
    by their texts; different classes that have the same smallest doc_id have the same
    class_id, and class_text (the smallest digest of a class's words, NULL without words)
    tells them apart. A NULL doc_id counts as an id made of the text, above all given ones
    (which are below 2^62); a class of such rows alone has the class_id NULL. Other columns
    are ignored.

    Copies are one node whatever their number. Prefix buckets are linked to their
    smallest node, never pair by pair; large groups are compared in pairs of blocks,
    which hand on one row per text.
    """
    rows = docs.select(_row_id().alias("doc_id"), _own().alias("own"), "text")
    given = lambda c: F.when(F.col(c) < FIRST_MADE_ID, F.col(c)).alias(c)
    return _classes(rows, threshold, shingle, trees, levels, recall).select(given("doc_id"), given("class_id"), "n_links", "n_copies", "class_text")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """All columns of one row per class of near duplicates: a row whose doc_id names it.

    Of a class's rows that share that doc_id the one with the least text stays (see
    `near_duplicates`); rows that share a doc_id but belong to different classes all stay.
    """
    options = {"threshold": THRESHOLD, "shingle": SHINGLE, "trees": TREES, "levels": LEVELS, "recall": RECALL} | options
    classes = _classes(docs.select(_row_id().alias("doc_id"), _own().alias("own"), "text"), **options)
    names = classes.where("doc_id = class_id").select("doc_id", "own", F.coalesce("class_text", F.lit("")).alias("class")).distinct()
    # The row travels whole, so that no name of its columns can clash with the names needed here.
    rows = docs.select(F.struct("*").alias("row"), _row_id().alias("doc_id"), _own().alias("own"), "text").join(names, ["doc_id", "own"])
    first = F.row_number().over(W.partitionBy("doc_id", "class").orderBy("text"))
    return rows.withColumn("nth", first).where("nth = 1").select("row.*")


def _row_id() -> Column:
    made = F.lit(FIRST_MADE_ID) + F.pmod(F.xxhash64("text"), F.lit(FIRST_MADE_ID - 1))
    return F.coalesce(F.col("doc_id").cast("long"), made)


def _own() -> Column:
    """Tells rows that share an id by their texts."""
    return F.xxhash64(F.lit(1), "text")


def _classes(rows: DataFrame, threshold: float, shingle: int, trees: int, levels: int, recall: float) -> DataFrame:
    depth = prefix_length(trees, levels, threshold, recall)
    rows_signed = written(signed(rows, trees, depth, shingle))
    # Written first, so that the joins below shuffle both sides and can split a key with very many rows.
    # A node is a text, whatever ids its rows have; its number is made as the row is written.
    copies = written(rows_signed.where("n_shingles > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")).withColumn("node", F.monotonically_increasing_id()))
    with_node = rows_signed.select("doc_id", "own", "hi", "lo").join(copies, ["hi", "lo"], "left")
    nodes = written(
        rows_signed.join(copies, ["hi", "lo"]).where("doc_id = first_id").dropDuplicates(["hi", "lo"])
        .select("node", "doc_id", "own", "hi", "lo", "n_shingles", "labels")
    )

    tries = nodes.select("node", F.posexplode("labels").alias("tree", "label")).select(
        "node", F.xxhash64("tree", F.shiftrightunsigned("label", 8 * (8 - depth))).alias("prefix"))
    buckets = written(
        tries.groupBy("prefix").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("prefix", "first"))
    edges = tries.join(buckets, "prefix").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    grouped = components(edges)

    members = grouped.join(nodes.drop("labels"), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n_shingles").alias("n_shingles"))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("n_shingles") / BLOCK_SHINGLES)).cast("int")
    members = members.join(sizes.select("component", blocks.alias("blocks")), "component").withColumn(
        "block", F.expr("cast(pmod(xxhash64(hi, lo), blocks) as int)"))
    compared = rows.join(members, ["doc_id", "own"])
    verified = written(_verified(_with_shingles(compared, shingle), threshold))

    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(verified.select(F.col("node").alias("u"), F.col("near").alias("v")))
    joined = classes.join(copies, "node")
    names = written(joined.groupBy("component").agg(
        F.min("first_id").alias("class_id"), F.min(_digest()).alias("class_text")))
    classes = written(classes.join(names, "component").select("node", "class_id", "class_text"))
    return (
        with_node.join(links, "node", "left")
        .join(classes, "node", "left")
        .select(
            "doc_id",
            "own",
            F.coalesce("class_id", "first_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
            F.coalesce("class_text", F.when(F.col("node").isNotNull(), _digest())).alias("class_text"),
        )
    )


def _digest() -> Column:
    return F.concat(*(F.lpad(F.hex(half), 16, "0") for half in ("hi", "lo")))


def _with_shingles(compared: DataFrame, shingle: int) -> DataFrame:
    """Each text's distinct shingles, once for every pair of blocks that its own is part of."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = Shingled(texts_of(batch), shingle)
            packed = [np.unique(made.hashes[a:b]).tobytes() for a, b in zip(made.starts[:-1], made.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("node", "component", "blocks", "block")], pa.array(packed, pa.binary())],
                names=["node", "component", "blocks", "block", "shingles"],
            )

    kept = compared.select("node", "component", "blocks", "block", "text")
    made = kept.mapInArrow(make, "node long, component long, blocks int, block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return made.select("node", "component", "block", other, "shingles").select(
        "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "shingles")
