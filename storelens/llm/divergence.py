"""How the sources of a language differ in their words: smoothed frequencies, recounted exactly.

A first pass counts in how many documents of its language each word stands; words in
enough of them are kept, exactly. Kept words get minimal perfect hashes in shards: a
shard's displacements and its words in slot order. The shards are broadcast in rounds of
bounded size. In the second pass each word finds its slot, is compared with the word
stored there, and adds to a dense vector of its (lang, source) group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import Words, slices, texts_of, written

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
# Words of a shard, which one task builds.
SHARD_WORDS = 50_000
# Characters and displacements broadcast at once, about; more shards go in further rounds.
ROUND_WORDS = 2_000_000
# Counters a task holds before it hands them on.
HELD = 6_000_000
# Cells of one block of a language's source x word matrix.
CELLS = 200_000

# Lower-case letters stay, capitals become lower, other ASCII separates words; bytes of all
# other characters belong to words.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def folded(texts: pa.Array) -> pa.Array:
    """The same texts with blanks between their words and A-Z lower-cased."""
    texts = pa.concat_arrays([texts])  # a slice with an offset becomes one without
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    bytes_ = pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)])
    return pa.LargeStringArray.from_buffers(len(texts), offsets, bytes_, offset=texts.offset)


# ---- first pass: documents per word -----------------------------------------------


def _added(parts: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): how many documents of the language hold the word. A task adds its own up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in slices(batches):
            words = Words(folded(texts_of(batch)))
            of_text = np.repeat(np.arange(batch.num_rows), words.counts())
            pairs = of_text * len(words.words) + words.codes
            # Half the width sorts in half the time, and nearly all batches fit it.
            narrow = batch.num_rows * len(words.words) < 2**32
            distinct = np.unique(pairs.astype(np.uint32) if narrow else pairs).astype(np.int64)
            text, word = np.divmod(distinct, max(len(words.words), 1))
            langs = batch.column("lang").dictionary_encode()
            cell, n = np.unique(langs.indices.to_numpy()[text].astype(np.int64) * len(words.words) + word, return_counts=True)
            lang, word = np.divmod(cell, max(len(words.words), 1))
            parts.append(pa.table({
                "lang": langs.dictionary.take(pa.array(lang)),
                "term": pa.array(words.words, pa.string()).take(pa.array(word)),
                "n": pa.array(n, pa.int64()),
            }))
            if sum(p.num_rows for p in parts) > HELD // 4:
                parts = [_added(parts, ["lang", "term"])]
                if parts[0].num_rows > HELD // 8:
                    yield from parts.pop().to_batches()
        if parts:
            yield from _added(parts, ["lang", "term"]).select(["lang", "term", "n"]).to_batches()

    return (
        # Tasks have added up what they can, so another sum before the shuffle would only cost.
        docs.select("lang", "text").mapInArrow(count, "lang string, term string, n long").repartition("lang", "term")
        .groupBy("lang", "term").agg(F.sum("n").alias("n"))
    )


# ---- minimal perfect hashes ---------------------------------------------------------


def _hashes(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of each word; strings of equal bytes have equal hashes everywhere."""
    h = pd.util.hash_array(words, hash_key=f"{seed:016d}", categorize=False)
    return (h >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class PerfectHash:
    """A bijection from n words to 0..n-1: a word's bucket has a displacement, or the very slot."""

    seed: int
    displacement: np.ndarray
    words: pa.Array

    @staticmethod
    def build(words: list[str]) -> PerfectHash:
        """Buckets of three words on average, the fullest first, each displaced until all its
        words fall into free slots; buckets of one word take what is left. Distinct words only."""
        values, n = np.array(words, object), len(words)
        seed = 0
        while (made := PerfectHash._displaced(values, n, seed)) is None:
            seed += 1  # two words of a bucket have equal hashes
        displacement, slots = made
        order = np.empty(n, np.int64)
        order[slots] = np.arange(n)
        return PerfectHash(seed, displacement, pa.array(values[order], pa.string()))

    @staticmethod
    def _displaced(values: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
        first, second = _hashes(values, seed)
        bucket = (first ^ second) % max(1, n // 3)
        size = np.bincount(bucket, minlength=max(1, n // 3))
        by_bucket = np.argsort(bucket, kind="stable")
        begin = np.cumsum(size) - size
        displacement = np.zeros(len(size), np.int64)
        slots = np.empty(n, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            own = by_bucket[begin[b] : begin[b] + size[b]]
            f, g = first[own] % n, second[own] % n
            if len(np.unique(f * n + g)) < len(own):
                return None
            # Displacements d * n + e move word i to f + d * g + e, all pairs once.
            for start in range(0, n * n, 256):
                d, e = np.divmod(np.arange(start, min(start + 256, n * n)), n)
                tried = np.sort((f[:, None] + d * g[:, None] + e) % n, axis=0)
                good = np.flatnonzero(free[tried].all(axis=0) & (np.diff(tried, axis=0) > 0).all(axis=0))
                if len(good):
                    break
            else:
                return None
            displacement[b] = start + good[0]
            slots[own] = (f + d[good[0]] * g + e[good[0]]) % n
            free[slots[own]] = False
        single = np.flatnonzero(size == 1)
        slots[by_bucket[begin[single]]] = left = np.flatnonzero(free)
        displacement[single] = -1 - left
        return displacement, slots

    def find(self, words: np.ndarray) -> np.ndarray:
        """Each word's slot, or -1 if it is not the word stored there."""
        n = len(self.words)
        first, second = _hashes(words, self.seed)
        moved = self.displacement[(first ^ second) % max(1, n // 3)]
        d, e = np.divmod(moved, n)
        slot = np.where(moved < 0, -1 - moved, (first % n + d * (second % n) + e) % n)
        same = pc.equal(self.words.take(pa.array(slot)), pa.array(words, pa.string()))
        return np.where(same.to_numpy(zero_copy_only=False), slot, -1)


SHARD = "lang string, shard int, seed int, displacement array<bigint>, words array<string>"


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """One row per shard of (lang, term, shard); a shard is built by one task."""

    def build(group: pa.Table) -> pa.Table:
        made = PerfectHash.build(sorted(group.column("term").to_pylist()))
        return pa.table({
            "lang": group.column("lang").slice(0, 1), "shard": group.column("shard").slice(0, 1),
            "seed": pa.array([made.seed], pa.int32()),
            "displacement": pa.array([made.displacement], pa.list_(pa.int64())), "words": pa.array([made.words.to_pylist()], pa.list_(pa.string())),
        })

    return kept.groupBy("lang", "shard").applyInArrow(build, SHARD)


def _shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (pd.util.hash_array(words, hash_key="shard-of-a-word-", categorize=False) % np.uint64(shards)).astype(np.int64)


def sharded(kept: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, term, shard) from (lang, term) and (lang, shards)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("term").to_numpy(zero_copy_only=False), batch.column("shards").to_numpy()
            shard = (pd.util.hash_array(words, hash_key="shard-of-a-word-", categorize=False) % n.astype(np.uint64)) if len(words) else n
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), pa.array(shard.astype(np.int32))], names=["lang", "term", "shard"])

    return kept.join(shards, "lang").select("lang", "term", "shards").mapInArrow(place, "lang string, term string, shard int")


# ---- second pass: counts per group and slot ------------------------------------------


def group_counts(docs: DataFrame, hashes: dict[tuple[str, int], PerfectHash], shards: dict[str, int]) -> DataFrame:
    """(lang, source, shard, slot, n) over the words that these hashes hold."""
    sent = docs.sparkSession.sparkContext.broadcast((hashes, shards))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = sent.value
        base: dict[str, dict[int, int]] = {}
        sizes: dict[str, int] = {}
        for lang, shard in sorted(own):
            base.setdefault(lang, {})[shard] = sizes.get(lang, 0)
            sizes[lang] = sizes.get(lang, 0) + len(own[lang, shard].words)
        held: dict[tuple[str, str], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), dense in held.items():
                for shard, start in base[lang].items():
                    n = dense[start : start + len(own[lang, shard].words)]
                    slot = np.flatnonzero(n)
                    same = lambda x, kind: pa.array([x] * len(slot), kind)
                    yield pa.RecordBatch.from_arrays(
                        [same(lang, pa.string()), same(source, pa.string()), same(shard, pa.int32()), pa.array(slot, pa.int32()), pa.array(n[slot])],
                        names=["lang", "source", "shard", "slot", "n"],
                    )
            held.clear()

        for batch in slices(batches):
            words = Words(folded(texts_of(batch)))
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            groups = sorted(set(zip(langs, sources, strict=True)))
            number = {g: k for k, g in enumerate(groups)}
            of_word = np.repeat([number[g] for g in zip(langs, sources, strict=True)], words.counts()).astype(np.int64)
            for lang in sorted({g[0] for g in groups} & base.keys()):
                mine = np.array([g[0] == lang for g in groups])[of_word] if len(of_word) else np.zeros(0, bool)
                used = np.unique(words.codes[mine])
                place = np.full(len(words.words) + 1, -1, np.int64)
                shard_of = _shard_of(words.words[used], numbers[lang]) if len(used) else np.zeros(0, np.int64)
                for shard in np.unique(shard_of).tolist():
                    if shard in base[lang]:
                        these = used[shard_of == shard]
                        slot = own[lang, shard].find(words.words[these])
                        place[these] = np.where(slot < 0, -1, slot + base[lang][shard])
                slot = place[words.codes]
                hit = mine & (slot >= 0)
                # Groups of this language in this slice, times its words: dense as what it is added to.
                group, slot = of_word[hit], slot[hit]
                order = np.argsort(group, kind="stable")
                first = np.searchsorted(group[order], np.arange(len(groups) + 1))
                for k in np.flatnonzero(np.diff(first)).tolist():
                    if groups[k] not in held:
                        if held and (1 + len(held)) * max(sizes.values()) > HELD:
                            yield from out()
                        held[groups[k]] = np.zeros(sizes[lang], np.int64)
                    held[groups[k]] += np.bincount(slot[order[first[k] : first[k + 1]]], minlength=sizes[lang])
        yield from out()

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, shard int, slot int, n long")
    return counted.repartition("lang", "source", "shard", "slot").groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def frequency(count: Column, total: Column, words: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 words)) in whole numbers; the product may pass 64 bits."""
    wide = (count + SMOOTHING).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTHING * words).cast("decimal(28,0)")
    return F.call_function("div", wide, below) + 1


def _frequencies(count: np.ndarray, total: np.ndarray, words: int) -> np.ndarray:
    """The same for arrays, by long division in steps of a thousand."""
    rest, below = count + SMOOTHING, total + SMOOTHING * words
    quotient = rest // below
    rest = rest % below
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // below, rest % below
    return quotient + 1


def _pair_sums(cells: pa.Table) -> pa.Table:
    """Sums of absolute differences between all sources over one block of words.

    Rows of slot -1 name every source of the language with its total and the number of
    words; the others are counts. Work goes by source against all, words x sources at a time.
    """
    t = cells.to_pandas()
    named = t[t["slot"] < 0].sort_values("source")
    sources = named["source"].to_numpy()
    cell = t[t["slot"] >= 0]
    columns, column = np.unique(cell["slot"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(sources), int(named["width"].iloc[0])), np.int64)
    counts[np.searchsorted(sources, cell["source"].to_numpy()), column] = cell["n"].to_numpy(np.int64)
    p = _frequencies(counts, named["n"].to_numpy(np.int64)[:, None], int(named["words"].iloc[0]))
    out = [np.abs(p - row).sum(axis=1) for row in p]
    k = len(sources)
    return pa.table({
        "lang": pa.array([t["lang"].iloc[0]] * (k * k), pa.string()), "source": pa.array(np.repeat(sources, k), pa.string()),
        "item": pa.array(np.tile(sources, k), pa.string()), "value": pa.array(np.concatenate(out), pa.int64()),
    })


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Part `pair`: every other source of the language with the summed differences of all
    kept words' frequencies. Part `term`: the words that are more frequent in the group
    than in its language, at most `top_terms` of them. Values descend with the rank, ties
    go by item. NULL text, lang and source are the empty text. A group without words has
    the smoothed frequencies; a language without kept words has pairs of value 0 and no
    terms; repeated rows count as often as they stand; other columns are not read. An
    empty table gives no rows.

    A hot language or source is summed in each task first. Pairs of sources are the
    result itself; their sums come from blocks of words of a bounded number of cells.
    Totals are exact up to 9 * 10^15 words per language.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = written(docs.select("lang", "source").distinct())
    kept = written(document_counts(docs).where(F.col("n") >= min_docs).select("lang", "term"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("words"))
    shards = sizes.select("lang", F.ceil(F.col("words") / SHARD_WORDS).cast("int").alias("shards"))
    tables = written(perfect_hashes(sharded(kept, shards)))
    layout = tables.select("lang", "shard", F.size("words").alias("n")).orderBy("lang", "shard").collect()
    numbers = {r["lang"]: r["shards"] for r in shards.collect()}

    rounds: list[list[tuple[str, int]]] = []
    room = 0
    for lang, shard, n in layout:
        if n > room:
            rounds.append([])
            room = max(ROUND_WORDS, n)
        rounds[-1].append((lang, shard))
        room -= n
    parts = []
    for chosen in rounds:
        wanted = reduce(lambda a, b: a | b, [(F.col("lang") == lang) & (F.col("shard") == shard) for lang, shard in chosen])
        own = {
            (r["lang"], r["shard"]): PerfectHash(r["seed"], np.array(r["displacement"], np.int64), pa.array(r["words"], pa.string()))
            for r in tables.where(wanted).collect()
        }
        parts.append(written(group_counts(docs, own, numbers)))
    empty = spark.createDataFrame([], "lang string, source string, shard int, slot int, n long")
    counts = reduce(DataFrame.unionByName, parts, empty)

    totals = written(
        groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("words", F.lit(0)).alias("words"))
    )
    return _pairs(groups, counts, totals, tables).unionByName(_terms(counts, totals, tables, top_terms))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _pairs(groups: DataFrame, counts: DataFrame, totals: DataFrame, tables: DataFrame) -> DataFrame:
    wide = totals.groupBy("lang").agg(F.greatest(F.lit(1), F.lit(CELLS) / F.count("*")).cast("int").alias("block_words"))
    # Slots of a language's shard in blocks; every source is named in every block.
    blocks = (
        tables.select("lang", "shard", F.size("words").alias("size")).join(wide, "lang")
        .select("lang", "shard", "size", "block_words", F.explode(F.sequence(F.lit(0), F.expr("(size - 1) div block_words"))).alias("block"))
    )
    named = blocks.join(totals, "lang").select(
        "lang", "shard", F.col("block").cast("long").alias("block"), "source", F.lit(-1).alias("slot"), F.col("total").alias("n"), "words",
        F.least(F.expr("size - block * block_words"), F.col("block_words").cast("long")).alias("width"),
    )
    cells = counts.join(wide, "lang").select(
        "lang", "shard", F.expr("slot div block_words").alias("block"), "source", "slot", "n", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("width"),
    )
    sums = (
        named.unionByName(cells).groupBy("lang", "shard", "block").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    valued = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    return _ranked(valued, "pair")


def _terms(counts: DataFrame, totals: DataFrame, tables: DataFrame, top_terms: int) -> DataFrame:
    of_lang = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("lang_n"))
    lang_total = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    p = frequency(F.col("n"), F.col("total"), F.col("words"))
    q = frequency(F.col("lang_n"), F.col("lang_total"), F.col("words"))
    valued = (
        counts.join(totals, ["lang", "source"]).join(lang_total, "lang").join(of_lang, ["lang", "shard", "slot"])
        .select("lang", "source", "shard", "slot", (p - q).alias("value")).where("value > 0")
    )
    words = tables.select("lang", "shard", F.posexplode("words").alias("slot", "item"))
    return _ranked(valued.join(words, ["lang", "shard", "slot"]), "term").where(F.col("rank") <= top_terms)
