from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storelens.llm import tokens
from storelens.llm.common import new_folder

LIBRARY = Tokenizer.from_file(tokens.vocabulary_file())
LIBRARY.encode_special_tokens = True
ENCODER = tokens.Encoder(tokens.vocabulary_file())


def whole(text: str) -> list[int]:
    return [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]


def ours(texts: list[str]) -> list[list[int]]:
    ids, starts = ENCODER.encode(pa.array(texts, pa.large_string()))
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_same_ids_as_the_library_on_any_text(texts):
    assert ours(texts) == [whole(t) for t in texts]


def test_same_ids_on_awkward_texts():
    chance = random.Random(2)
    parts = [*"abXYZÀéßİıſΣς'sdt  \n\t\x0b\x1c\x85.,!?<|>%019½²ªµÿŒǅ́カ🙂​_-×÷", "don't", "'re", "'LL", "<|endoftext|>", "o'reilly"]
    texts = ["".join(chance.choices(parts, k=chance.randrange(20))) for _ in range(3000)]
    assert ours(texts) == [whole(t) for t in texts]


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES_KEPT", 3)
    texts = [f"word{k} other{k} again" for k in range(50)]
    assert [ours([t])[0] for t in texts] == [whole(t) for t in texts]


ROWS = [(5, "five words are in here", "x"), (None, "no id", "x"), (2, None, None), (3, "", "y"), (2, "again two", "y"), (5, "five words are in here", "z"),
        (-4, "long " * 30_000, "z")]


def test_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    folder = new_folder(spark)
    shards = tokens.write_token_files(docs, folder)
    got = sorted(tokens.read_documents(spark, folder, shards).collect(), key=lambda r: r.start)
    expected = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for row, (doc_id, text, _) in zip(got, expected, strict=True):
        ids = whole(text or "")
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [s["base_tokens"] for s in shards] == np.cumsum([0, *[s["n_tokens"] for s in shards]])[:-1].tolist()


def test_files_hold_plain_numbers(spark):
    folder = new_folder(spark)
    (shard,) = tokens.write_token_files(spark.createDataFrame(ROWS[:1], "doc_id long, text string, x string").coalesce(1), folder, width=4)
    assert np.fromfile(shard["ids_file"], "<u4").tolist() == whole(ROWS[0][1])
    assert np.fromfile(shard["offsets_file"], "<i8").tolist() == [0, shard["n_tokens"]]
    assert np.fromfile(shard["docs_file"], "<i8").tolist() == [5]


def test_an_id_that_does_not_fit_fails(spark):
    docs = spark.createDataFrame([(1, "ordinary")], "doc_id long, text string")
    with pytest.raises(Exception, match="needs more than 1 bytes"):
        tokens.write_token_files(docs, new_folder(spark), width=1)


def test_empty_table(spark):
    folder = new_folder(spark)
    shards = tokens.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert shards == [] and tokens.read_documents(spark, folder, shards).count() == 0


def test_special_tokens_as_the_unmodified_library_has_them(spark):
    library = Tokenizer.from_file(tokens.vocabulary_file())
    chance = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "word", "don't", "é", "カ", " ", "\n", "7", "!"]
    texts = ["a<|endoftext|>b", *("".join(chance.choices(parts, k=chance.randrange(12))) for _ in range(2000))]
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    ids, starts = tokens.encoder(tokens.vocabulary_file()).encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want
    assert 49407 in want[0]
    folder = new_folder(spark)
    shards = tokens.write_token_files(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), folder)
    assert [r.n_tokens for r in tokens.read_documents(spark, folder, shards).collect()] == [len(want[0])]


def test_another_vocabulary_goes_through_its_own_rules(spark):
    file = tokens.vocabulary_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    assert ENCODER.by_word and not tokens.Encoder(file).by_word
    texts = ["Hello World, don't  stop\n", "", "a<|endoftext|>b", "çé カ\t7", "x " * 5000]
    ids, starts = tokens.encoder(file).encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    folder = new_folder(spark)
    shards = tokens.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, file)
    assert sum(s["n_tokens"] for s in shards) == len(ids)


def test_one_doc_id_is_many_shards(spark):
    """Rows of one doc_id, a third of all or more, part by their texts."""
    rows = [(7, f"text {k:04d} " + "word " * (k % 9)) for k in range(2000)] + [(8, "x")]
    folder = new_folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = tokens.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shards) > 4 and max(s["n_docs"] for s in shards) < 700
    got = sorted(tokens.read_documents(spark, folder, shards).collect(), key=lambda r: r.start)
    assert [r.n_tokens for r in got] == [len(whole(t)) for _, t in sorted(rows)]
