from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from storelens.llm.packing import best_pattern, pack, patterns, powers_of_two
from tests.llm.test_tokens import whole


def test_best_pattern_matches_all_multisets():
    def best(sizes, prices, room):
        return 0.0 if room == 0 else max([-np.inf, *(p + best(sizes, prices, room - s) for s, p in zip(sizes, prices, strict=True) if s <= room)])

    chance = random.Random(1)
    for _ in range(30):
        sizes = sorted(chance.sample(range(2, 12), 3))
        prices = [chance.random() - 0.2 for _ in sizes]
        value, counts = best_pattern(np.array(sizes), np.array(prices), 14)
        assert value == -np.inf == best(sizes, prices, 14) or abs(value - best(sizes, prices, 14)) < 1e-9
        if value > -np.inf:
            assert counts @ np.array(sizes) == 14 and abs(counts @ np.array(prices) - value) < 1e-9
    assert best_pattern(np.array([4, 6]), np.ones(2), 9)[0] == -np.inf


def test_patterns_are_full_and_leave_little():
    chance = np.random.default_rng(4)
    sizes = np.arange(8, 110)
    demand = chance.integers(0, 400, len(sizes)).astype(float)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    chosen = patterns(sizes, demand, 128)
    assert (sum(times * column for column, times in chosen) <= demand).all()
    assert all(column @ sizes == 128 for column, _ in chosen)
    # Without these large sizes, which small ones are too few to go with, next to all fits.
    assert sum(times for _, times in chosen) * 128 > 0.6 * (sizes @ demand)
    small = sizes <= 64
    chosen = patterns(sizes[small], demand[small], 128)
    assert sum(times for _, times in chosen) * 128 > 0.97 * (sizes[small] @ demand[small])


def test_powers_of_two():
    assert [powers_of_two(n) for n in (0, 1, 6, 2047)] == [[], [1], [4, 2], [1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]]


def check(rows: list, docs: dict[int, list[list[int]]], sequence: int) -> list[int]:
    """Every id of every document once, every sequence without a gap; the sequences' sizes."""
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for doc_id, versions in docs.items():
        wanted = sorted((a, n, zlib.crc32(np.array(v[a : a + n], "<u4").tobytes()), len(v)) for v in versions for a, n in
                        {(r.start, r.length) for r in pieces[doc_id]} if a + n <= len(v))
        got = [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc_id]]
        assert set(got) <= set(wanted)
        assert sum(n for _, n, _, _ in got) == sum(map(len, versions))
        if len(versions) == 1:
            at = 0
            for start, n, _, _ in sorted(got):
                assert start == at
                at += n
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= sequence
    assert sorted(sequences) == list(range(len(sequences)))
    return [sum(n for _, n in parts) for parts in sequences.values()]


def test_every_id_once_and_nothing_padded(spark):
    chance = random.Random(8)
    rows = [(k, " ".join(chance.choice(["alpha", "bet", "gamma's", "7"]) for _ in range(chance.choice([1, 5, 40, 41, 90, 300]))), k) for k in range(400)]
    rows += [(1000, None, 1), (1001, "", 1), (None, "no id", 1), (1002, "very long " * 3000, 1), (1003, "twice", 1), (1003, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(5, "doc_id")
    ids = defaultdict(list)
    for doc_id, text, _ in rows:
        ids[doc_id].append(whole(text or ""))
    got = pack(docs, sequence=256, grain=4, shortest=16).collect()
    sizes = check(got, ids, 256)
    assert all(n & (n - 1) == 0 for n in sizes)
    assert sum(n != 256 for n in sizes) <= 8
    # Most documents that fit a sequence stay whole.
    whole_docs = sum(r.length == r.doc_tokens for r in got)
    assert whole_docs > 0.5 * sum(len(v) <= 256 for versions in ids.values() for v in versions)


def test_one_length_for_all_documents(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'the very same few words' AS text").repartition(4)
    ids = {k: [whole("the very same few words")] for k in range(300)}
    sizes = check(pack(docs, sequence=64, grain=1, shortest=2).collect(), ids, 64)
    assert all(n & (n - 1) == 0 for n in sizes)


def test_empty_table(spark):
    got = pack(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
