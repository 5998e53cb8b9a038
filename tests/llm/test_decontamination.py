from __future__ import annotations

import random
import subprocess
import sys

import numpy as np
import pytest

from storelens.llm.decontamination import Passages, best_ends, clean_documents, find_passages


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def symbols(text: str) -> np.ndarray:
    return np.array([ord(c) for c in text], np.uint32)


def test_alignment_matches_all_substrings():
    chance = random.Random(3)
    passages = ["".join(chance.choice("abc") for _ in range(chance.randrange(1, 9))) for _ in range(150)]
    texts = ["".join(chance.choice("abc") for _ in range(chance.randrange(1, 14))) for _ in passages]
    line = "".join(texts)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    places = [(end - len(t), end, -8) for t, end in zip(texts, ends, strict=True)]  # bands wide enough for the whole
    got = best_ends([symbols(p) for p in passages], symbols(line), places, 40)
    for passage, text, (end, edits) in zip(passages, texts, got, strict=True):
        best = min(distance(passage, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert edits == best
        end = min(end - 8, len(text))
        assert min(distance(passage, text[i : max(end, 0)]) for i in range(max(end, 0) + 1)) == best


def edited(text: str, n: int, chance: random.Random) -> str:
    symbols = list(text)
    for _ in range(n):
        at = chance.randrange(len(symbols))
        kind = chance.randrange(3)
        if kind == 0:
            symbols[at] = chance.choice("xyz")
        elif kind == 1:
            symbols.insert(at, chance.choice("xyz"))
        else:
            del symbols[at]
    return "".join(symbols)


def test_every_passage_within_the_budget_is_found():
    chance = random.Random(11)

    def words(n: int) -> str:
        return " ".join("".join(chance.choice("abcdefgh") for _ in range(chance.randrange(2, 8))) for _ in range(n))

    items = [(k, words(30)) for k in range(20)]
    index = Passages(items)
    for item, text in items:
        for n in (0, 3, int(index.budget[item])):
            line = words(40) + " " + edited(text, n, chance) + " " + words(40)
            got = index.matches([words(50), line])
            assert [(m[0], m[1]) for m in got] == [(1, item)] and got[0][4] <= n
            assert distance(text, line[got[0][2] : got[0][3]]) <= n + 2
        too_far = words(10) + " " + edited(text, 6 * int(index.budget[item]), chance)
        assert all(m[4] <= index.budget[item] for m in index.matches([too_far]))


@pytest.fixture
def benchmark(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog near the river bank today."), (1, None), (2, ""), (3, "a cat"), (4, " ?! "),
            (5, " ".join(f"word{k} of a long item" for k in range(100)))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_documents(spark, benchmark):
    rows = [
        (1, None, 0), (2, "", 0), (3, " ?!", 0),
        (4, "Once: the QUICK brown-fox jumps over the lazy dog, near the river bank today! End", 0),
        (4, "Once: the QUICK brown-fox jumps over the lazy dog, near the river bank today! End", 0),
        (5, "the quick brown fox jumped over a lazy dog near the river bank today", 0),
        (6, "the quick brown fox is not near any bank", 0),
        (7, "with a cat", 0), (8, "with a cats", 0),
        (None, "filler " * 40_000 + " ".join(f"word{k} of a long item" for k in range(20, 60)), 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.item_id, r.edits) for r in find_passages(docs, benchmark).collect())
    assert [g for g in got if g[0] != 99] == [(4, 1, 0), (4, 1, 0), (5, 1, 5), (7, 3, 0)]
    assert {g[:2] for g in got if g[0] == 99} == {(99, 5)}
    spans = {r.doc_id: (r.start, r.end) for r in find_passages(docs, benchmark).collect()}
    assert rows[3][1][slice(*spans[4])] == "the QUICK brown-fox jumps over the lazy dog, near the river bank today"
    clean = clean_documents(docs, benchmark)
    assert clean.schema == docs.schema
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 6, 8]


def test_empty_tables(spark, benchmark):
    docs = spark.createDataFrame([(1, "the quick brown fox")], "doc_id long, text string")
    assert find_passages(docs.limit(0), benchmark).count() == 0
    assert find_passages(docs, benchmark.limit(0)).count() == 0
    assert clean_documents(docs, benchmark.limit(0)).count() == 1


def test_places_do_not_depend_on_what_else_is_aligned():
    chance = random.Random(8)
    short, long = ("".join(chance.choice("abcdefghijklmnop") for _ in range(n)) for n in (40, 300))
    line = "q " + short[:20] + "z" + short[21:] + " " + short + " q"
    alone = Passages([(1, short)]).matches([line])
    assert sorted((m[2], m[4]) for m in alone) == [(2, 1), (43, 0)]
    both = Passages([(1, short), (2, long)]).matches([line, long])
    assert [m for m in both if m[1] == 1] == alone and [m[:2] for m in both if m[1] == 2] == [(1, 2)]


@pytest.mark.parametrize("length", range(9, 90))
def test_short_passages_have_all_their_edits(length):
    chance = random.Random(length)
    for _ in range(6):
        text = "".join(chance.choice("abcdefgh") for _ in range(length))
        budget = length // 10
        index = Passages([(1, text), (2, "ab cd " * 30)])
        assert index.budget[0] == budget and index.bound[0] >= 1
        # Edits as far apart as can be leave the shortest stretches unharmed.
        line = list(text)
        for k in range(budget):
            line[(k + 1) * length // (budget + 1)] = chance.choice("xyz")
        for near in ("".join(line), edited(text, budget, chance)):
            assert [m[:2] for m in index.matches(["none", "qq " + near + " qq"])] == [(1, 1)]


def nearest(passage: str, text: str) -> int:
    """Fewest edits between the passage and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("seed", range(3))
def test_documents_with_edited_places_by_brute_force(seed):
    """Whole documents: an item is found where some stretch is within its edits, and nowhere else."""
    chance = random.Random(seed)
    letters = lambda n: "".join(chance.choice("abcdef") for _ in range(n))
    items = [(k, letters(chance.choice([12, 15, 22, 31, 40, 64, 90, 130]))) for k in range(12)]
    texts = []
    for _ in range(60):
        parts = [letters(chance.randrange(40))]
        for _ in range(chance.randrange(4)):
            _, text = chance.choice(items)
            parts += [edited(text, chance.randrange(len(text) // 10 + 3), chance), letters(chance.randrange(30))]
        texts.append("".join(parts))
    index = Passages(items)
    found = index.matches(texts)
    wanted = {(t, k) for t, text in enumerate(texts) for k, item in items if nearest(item, text) <= len(item) // 10}
    assert len(wanted) > 40 and {m[:2] for m in found} == wanted
    for t, k, a, b, edits in found:
        assert distance(items[k][1], texts[t][a:b]) == edits <= len(items[k][1]) // 10


HELD = """
import random, resource, sys
from storelens.llm.decontamination import Passages
Passages([(1, "some passage of a benchmark")]).matches(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
chance = random.Random(1)
words = lambda n: " ".join("".join(chance.choice("abcdefgh") for _ in range(chance.randrange(2, 8))) for _ in range(n))
if sys.argv[1] == "repetitive":
    found = Passages([(1, "ha" * 150)]).matches(["ha" * 100_000])
    assert len(found) > 600 and all(m[4] == 0 for m in found)
else:
    head = "answer the following question with a single word "
    items = [(k, head + words(25)) for k in range(700)]
    found = Passages(items).matches([" ".join(head + words(3) for _ in range(700)) + " " + items[7][1]])
    assert [m[1] for m in found] == [7]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("kind", ["repetitive", "one beginning"])
def test_memory_is_bounded(kind):
    """Shared grams x occurrences are 29 and 20 million here, 24 bytes each at least."""
    done = subprocess.run([sys.executable, "-c", HELD, kind], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 350
