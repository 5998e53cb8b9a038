from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from storelens.llm.topk import quantized, top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, divisor=10):
    vectors = []
    for vec_id, x, _ in rows:
        if vec_id is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            vectors.append((vec_id, [math.floor(256 * c) for c in x]))
    queries = {}
    for vec_id, v in vectors:
        if vec_id % divisor == 0:
            queries[vec_id] = min(queries.get(vec_id, v), v)
    result = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
        result += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(result)


def answer(spark, rows, k, **options):
    vectors = quantized(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 10 == 0, k, **options).collect())


@pytest.fixture
def rows():
    chance = random.Random(6)
    made = [(k, [chance.choice([0.5, 0.25, -0.125, chance.gauss(0, 1)]) for _ in range(10)], 0) for k in range(120)]
    made += [(200 + k, made[10][1], 0) for k in range(40)]  # one common vector
    made += [(300, None, 0), (301, [], 0), (310, [1.0, None] * 5, 0), (320, [float("nan")] * 10, 0), (330, [float("inf")] * 10, 0), (None, [1.0] * 10, 0)]
    made += [(340, [1.0, 2.0], 0), (341, [3.0, 1.0], 0), (10, [-9.0] * 10, 0), (55, made[55][1], 0)]
    return made


@pytest.mark.parametrize("options", [{}, {"lists": 1}, {"lists": 10}, {"lists": 40}, {"query_block": 4}])
def test_matches_scoring_everything(spark, rows, options):
    assert answer(spark, rows, 5, **options) == brute(rows, 5)


def test_fewer_others_than_k(spark):
    rows = [(10, [1.0, -1.0], 0), (11, [-2.0, 0.5], 0), (12, [0.0, 0.0], 0)]
    assert answer(spark, rows, 5) == brute(rows, 5) == [(10, 1, 12, 0), (10, 2, 11, -163840)]
    assert answer(spark, rows[:1], 5) == []


def test_scores_beyond_doubles(spark):
    rows = [(0, [5e6, 1.0], 0), (1, [5e6, 2.0], 0), (2, [5e6, 1.0], 0), (3, [5e6, -1.0], 0)]
    assert answer(spark, rows, 2) == brute(rows, 2)


def test_empty_table(spark, rows):
    assert answer(spark, rows[:0], 5) == []
    assert answer(spark, rows[1:9], 5) == []  # no query among them


def test_empty_vectors_ask_each_other(spark, rows):
    rows = [*rows, (350, [], 0), (351, [], 0)]
    got = answer(spark, rows, 5)
    assert got == brute(rows, 5) and [r for r in got if r[0] == 350] == [(350, 1, 301, 0), (350, 2, 351, 0)]
    assert answer(spark, [(350, [], 0)], 5) == []


def test_beyond_longs_it_fails_and_below_it_is_exact(spark):
    near = [(0, [7e6, 1.0, 0.0], 0), (1, [7e6, 2.0, -7e6], 0), (2, [7e6, 1.0, 1.0], 0), (10, [0.0, 3.0, 7e6], 0)]
    assert answer(spark, near, 3) == brute(near, 3)
    for wide in (1e15, -1e15, 1e300):
        double = spark.createDataFrame([(0, [wide, 1.0]), (1, [wide, 2.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="does not fit"):
            top_k(quantized(double), F.col("vec_id") % 50 == 0, 2).collect()
