"""Source divergence beside plain Python, and its perfect hashes."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from storelens.llm import divergence
from storelens.llm.divergence import PerfectHash

SCHEMA = "lang string, source string, text string, n int, shard string"


def brute(rows: list[tuple], min_docs: int, top: int) -> set[tuple]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    groups = defaultdict(set)
    for lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def p(count: Counter) -> dict[str, int]:
            below = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // below for t in kept}

        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(own[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out |= {(lang, s, part, o, f, k) for k, (f, o) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


def random_rows(seed: int, n: int = 120) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["Ab", "été", "b", "C3d", "ΩΩ", "x_y", "", " ", "zz", *(chr(97 + k) * 2 for k in range(20))]
    return [
        (
            rnd.choice(["en", "en", "en", "fr", None, ""]), rnd.choice(["s1", "s1", "s2", "sé", None]),
            rnd.choice([None, "", *[rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(8)]]), 1, "x",
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize(("min_docs", "top"), [(3, 5), (1, 50), (40, 2), (1000, 5)])
def test_by_brute_force(spark, min_docs, top):
    rows = random_rows(min_docs)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA), min_docs, top).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, min_docs, top)


def test_many_shards_rounds_and_blocks(spark, monkeypatch):
    """Small bounds: several shards per language, a round per shard or two, blocks of few words."""
    for name, value in (("SHARD_WORDS", 5), ("ROUND_WORDS", 12), ("CELLS", 16), ("HELD", 40)):
        monkeypatch.setattr(divergence, name, value)
    rows = random_rows(11, 300)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), 2, 4).collect()
    assert {tuple(r) for r in got} == brute(rows, 2, 4)


def test_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_perfect_hash(n):
    words = [f"w{k * 7919:x}" for k in range(n)]
    made = PerfectHash.build(words)
    slots = made.find(np.array(words, object))
    assert sorted(slots.tolist()) == list(range(n))
    assert (made.find(np.array([f"other{k}" for k in range(50)], object)) == -1).all()


def test_exact_frequencies():
    rnd = random.Random(3)
    for _ in range(200):
        total, words = rnd.randint(0, 9 * 10**14), rnd.randint(1, 10**9)
        count = rnd.randint(0, total)
        wanted = 1 + 1_000_000_000 * (count + 5) // (total + 5 * words)
        assert int(divergence._frequencies(np.array([[count]]), np.array([[total]]), words)[0, 0]) == wanted


def test_long_text_and_slices_with_an_offset():
    long = "Aa " * 2_000_000
    assert divergence.folded(pa.array(["x1y", long], pa.large_string()).slice(1, 1)).to_pylist() == [long.lower()]
