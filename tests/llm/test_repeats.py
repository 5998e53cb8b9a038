"""Repeated byte strings beside brute force over all places."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from storelens.llm import queries, repeats
from storelens.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, n_bytes int"


def brute(texts: list[str | None], length: int = repeats.LENGTH) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((len(d), int(gone.sum()), spans, left))
    return out


def test_every_distance_is_covered_once():
    assert sorted((a - b) % repeats.CYCLE for a in repeats.COVER for b in repeats.COVER if a != b) == list(range(1, repeats.CYCLE))


def random_texts(rnd: random.Random, n: int, alphabet: str = "abcdefghij é") -> list[str]:
    """Texts made of shared passages of all lengths around the limit, cut and shifted."""
    word = lambda k: "".join(rnd.choices(alphabet, k=k))
    shared = [word(rnd.choice([395, 399, 400, 401, 450, 700, 1200])) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            kind = rnd.random()
            if kind < 0.5:
                parts.append(rnd.choice(shared))
            elif kind < 0.7:
                whole = rnd.choice(shared)
                cut = rnd.randint(0, len(whole) // 2)
                parts.append(whole[cut:] + whole[: cut // 2])
            parts.append(word(rnd.choice([0, 1, 7, 60, 300])))
        texts.append("".join(parts))
    return texts


def check(spark, texts: list[str | None], partitions: int = 3) -> None:
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA).repartition(partitions)
    got = sorted(map(tuple, repeats.remove_repeats(docs, "doc_id").collect()))
    assert got == [(k, *row) for k, row in enumerate(brute(texts))]


@pytest.mark.parametrize("seed", range(4))
def test_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = random_texts(rnd, 60)
    check(spark, [*texts, None, "", "a" * 399, "a" * 400, rnd.choice(texts), *[max(texts, key=len)] * 3])


def test_repetition_within_a_text(spark):
    check(spark, ["ab" * 250, "x" * 1000, "y" * 400, "0123456789" * 41 + "z" * 401, "q" * 401])


def test_one_byte_apart(spark):
    """Copies at all shifts against the cover, with matches of just the length and just below."""
    rnd = random.Random(9)
    core = "".join(rnd.choices("abcdefgh", k=400))
    filler = lambda k: "".join(rnd.choices("ijklmnop", k=k))
    check(spark, [filler(k) + core + filler(3) for k in (0, 1, 91, 182, 183, 500)] + [core[1:] + "!" + filler(5), "!" + core[:-1]])


def test_small_pieces_and_flights(spark, monkeypatch):
    """Texts in many pieces and tasks with many flights, in this process."""
    for name, value in (("PIECE", 900), ("FLIGHT", 400), ("STRETCH", 4)):
        monkeypatch.setattr(repeats, name, value)
    rnd = random.Random(4)
    texts = [t for t in random_texts(rnd, 40) if len(t.encode()) >= 400]
    texts = list(dict.fromkeys(texts))
    cells = lambda step, more: local(lambda df: repeats._cells(df, step, 5), {"digest": [hashlib.md5(t.encode()).digest() for t in texts], "text": texts} | more)
    live = local_answers(cells("sample", {}), np.uint32)
    names = [hashlib.md5(t.encode()).digest() for t in texts]
    ahead = {"live": [live.get(n, ([], []))[0] for n in names]}
    classed = local_answers(cells("stretches", ahead), classes=True)
    more = ahead | {"settled": [classed.get(n, ([], []))[0] for n in names], "reps": [classed.get(n, ([], []))[1] for n in names]}
    marks = local_answers(cells("strings", more))
    got = [
        repeats.without(t.encode(), repeats.merged(np.frombuffer(b"".join(marks[n][0]), np.int64).reshape(-1, 2))) if n in marks else (0, 0, t.encode())
        for t, n in zip(texts, names, strict=True)
    ]
    assert got == [row[1:] for row in brute(texts)]


class _Local:
    """Takes the place of a DataFrame: keeps the functions that a plan would run."""

    def __init__(self) -> None:
        self.calls = []

    def __getattr__(self, name):
        def call(*args, **_):
            self.calls.append((name, args))
            return self

        return call


def local(plan, columns: dict) -> list[dict]:
    frame = _Local()
    plan(frame)
    run = next(args[0] for name, args in frame.calls if name == "mapInArrow")
    kinds = {"digest": pa.binary(), "text": pa.string(), "live": pa.list_(pa.binary()), "settled": pa.list_(pa.binary()), "reps": pa.list_(pa.binary())}
    batch = pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in columns.items()], names=list(columns))
    half = batch.num_rows // 2
    return [row for part in (batch.slice(0, half), batch.slice(half)) for out in run(iter([part])) for row in out.to_pylist()]


def local_answers(rows: list[dict], *args, **kwargs) -> dict[bytes, tuple[list, list]]:
    frame = _Local()
    repeats.answered(frame, *args, **kwargs)
    answer, deliver = (args[0] for name, args in frame.calls if name == "applyInArrow")
    schema = lambda text: pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.binary()) for c in text.split(", ")])
    grouped = lambda rows, key: [[r for r in rows if r[key] == k] for k in dict.fromkeys(r[key] for r in rows)]
    answers = [r for g in grouped(rows, "bucket") for r in answer(pa.Table.from_pylist(g, schema(repeats.CELL))).to_pylist()]
    out: dict[bytes, tuple[list, list]] = {}
    for g in grouped(answers, "flight"):
        for r in deliver(pa.Table.from_pylist(g, schema(repeats.ANSWER))).to_pylist():
            marks, reps = out.setdefault(r["digest"], ([], []))
            marks.append(r["marks"])
            reps.append(r["reps"])
    return out


def test_places_far_apart():
    for places in ([], [0], [65534, 65535, 65536, 131070, 10**6], [7, 7 + 65535 * 3]):
        assert repeats.read_places(repeats.written_places(np.array(places, np.int64))).tolist() == places


def test_no_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA), "doc_id").collect() == []


def test_query_by_brute_force(spark):
    rows = table(spark, SF, "documents").orderBy("doc_id").collect()
    wanted = {r.doc_id: (n, gone, spans, hashlib.sha256(left).hexdigest()) for r, (n, gone, spans, left) in zip(rows, brute([r.text for r in rows]), strict=True)}
    got = {r[0]: tuple(r[1:]) for r in queries.op11_repeated_bytes(spark, SF).collect()}
    assert got == wanted
    assert any(w[1] for w in wanted.values())
