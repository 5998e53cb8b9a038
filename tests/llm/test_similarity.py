from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from storelens.llm import similarity
from storelens.llm.components import components


def grams(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """Class, links and copies of each id (ids are not repeated), by comparing all texts."""
    words = defaultdict(list)
    for doc_id, text, *_ in rows:
        words[tuple((text or "").lower().split())].append(doc_id)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    sets = {w: grams(" ".join(w)) for w in words}
    keys = [w for w in words if w]
    for w in keys:
        for doc_id in words[w]:
            a, b = root(doc_id), root(words[w][0])
            parent[max(a, b)] = min(a, b)
    for i, v in enumerate(keys):
        for w in keys[:i]:
            shared = len(sets[v] & sets[w])
            if 5 * shared >= 4 * len(sets[v] | sets[w]):
                links[v] += 1
                links[w] += 1
                a, b = root(words[v][0]), root(words[w][0])
                parent[max(a, b)] = min(a, b)
    return {
        doc_id: (root(doc_id), links[w], len(words[w]) if w else 1) for w, ids in words.items() for doc_id in ids
    }


def near_copies(chance: random.Random, n: int, copies: int, words: int = 60) -> list[str]:
    texts = []
    for _ in range(n):
        base = [f"w{chance.randrange(3000)}" for _ in range(words)]
        for _ in range(copies):
            own = base.copy()
            for _ in range(chance.randrange(4)):
                own[chance.randrange(words)] = f"w{chance.randrange(3000)}"
            texts.append(" ".join(own))
    return texts


def result(df) -> dict[int, tuple[int, int, int]]:
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in df.collect()}


@pytest.fixture
def mixed(spark):
    chance = random.Random(21)
    texts = near_copies(chance, 12, 6) + near_copies(chance, 1, 90) + ["same words here"] * 40 + ["Same WORDS\nhere", "", None, "  ", "a b", "a  b", "a b c"]
    passage = " ".join(f"p{k}" for k in range(12))
    texts += [f"{passage} " + " ".join(f"v{chance.randrange(9999)}" for _ in range(50)) for _ in range(30)]
    chance.shuffle(texts)
    return [(k, t, "label") for k, t in enumerate(texts)]


def test_matches_comparing_all_texts(spark, mixed):
    docs = spark.createDataFrame(mixed, "doc_id long, text string, class_id string").repartition(4)
    assert result(similarity.near_duplicates(docs)) == brute(mixed)


def test_blocks_of_a_large_group_lose_no_link(spark, mixed, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 16)
    docs = spark.createDataFrame(mixed, "doc_id long, text string, class_id string")
    assert result(similarity.near_duplicates(docs)) == brute(mixed)


def test_one_of_each(spark, mixed):
    rows = [*mixed, (5000, "twice the id", ""), (5000, "twice the id", ""), (None, "without id", ""), (None, "without id", ""), (None, "another one", ""), (None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = similarity.one_of_each(docs)
    assert kept.schema == docs.schema
    got = kept.collect()
    classes = {c for c, _, _ in brute(mixed).values()}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted([*classes, 5000])
    assert sorted((r.text or "") for r in got if r.doc_id is None) == ["", "another one", "without id"]


def test_rows_that_share_an_id_share_a_class(spark):
    rows = [(1, "one two three four five six"), (1, "something else entirely and longer"), (2, "something else entirely and longer"), (3, "one two three")]
    got = similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_null_ids(spark):
    rows = [(None, "x y z"), (None, "x y z"), (7, "x y z"), (None, "alone")]
    got = similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_copies) for r in got), key=str) == [(7, 7, 3), (None, 7, 3), (None, 7, 3), (None, None, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.near_duplicates(docs).count() == 0
    assert similarity.one_of_each(docs).count() == 0


def test_prefixes_are_shortened_to_the_target():
    depth = similarity.prefix_length()
    assert similarity.recall_at(depth, similarity.TREES, similarity.THRESHOLD) >= similarity.RECALL
    assert depth == similarity.LEVELS or similarity.recall_at(depth + 1, similarity.TREES, similarity.THRESHOLD) < similarity.RECALL


def test_shared_counts():
    chance = np.random.default_rng(1)
    sets = [np.unique(chance.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    alone = similarity.shared_counts(sets, None)
    np.fill_diagonal(alone, [len(s) for s in sets])  # what a set shares with itself is not counted
    assert alone.tolist() == expected
    assert similarity.shared_counts(sets[:4], sets[4:]).tolist() == [row[4:] for row in expected[:4]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_graphs(spark, seed):
    chance = random.Random(seed)
    edges = [(chance.randrange(200), chance.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("copies", [2, 3])
def test_empty_blocks_count_no_link_again(spark, monkeypatch, copies):
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 20)
    rows = list(enumerate(near_copies(random.Random(copies), 6, copies)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(similarity.near_duplicates(docs)) == brute(rows)


def test_texts_that_share_an_id_are_not_joined(spark):
    words = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]
    rows = [(1, words[0]), (1, words[1]), (1, words[1].upper()), (2, words[1] + " more"), (3, words[2]), (1, words[2] + " end"), (1, None), (4, words[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in similarity.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(1, words[0]), (1, words[1].upper()), (1, words[2] + " end"), (1, None), (4, words[3])], key=str)
    got = similarity.near_duplicates(docs).collect()
    assert sorted(r.class_id for r in got) == [1] * 7 + [4] and len({r.class_text for r in got}) == 5
    assert sorted(r.n_links for r in got) == [0, 0, 0, 1, 1, 1, 1, 1]


def test_one_of_each_keeps_columns_of_any_name(spark):
    names = ["__id", "__own", "__nth", "__class", "own", "class", "row", "nth", "class_id", "a.b"]
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, *range(10)), (2, text, *range(10, 20)), (3, "something else in a few words", *range(20, 30))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = similarity.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
