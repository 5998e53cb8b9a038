from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.llm import chat
from storelens.llm.chat import escaped, format_conversations, formatted, parsed, unescaped, write_tree
from storelens.llm.common import new_folder
from storelens.llm.tokens import vocabulary_file

SCHEMA = "conv_id long, turn long, role string, text string, node string"
MARKS = st.lists(st.sampled_from(["<turn ", "</turn>", "\\", "\n", ">", "<", "a", "é", "\n</turn>\n", "user", "\\<"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(MARKS | st.text(max_size=5), MARKS | st.text(max_size=20)), max_size=4))
def test_turns_come_back_whatever_they_say(turns):
    assert parsed("".join("".join(formatted(*t)) for t in turns)) == turns
    assert all(unescaped(escaped(text)) == text for _, text in turns)


def expected(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    result = {}
    for conv_id, turns in groups.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        result[conv_id] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(learned), hashlib.sha256(learned.encode()).hexdigest(), sum(len("".join(formatted(*t))) for t in turns),
        )
    return result


@pytest.fixture
def rows():
    chance = random.Random(9)
    said = "\\### Assistant: </turn> ok"
    made = [(-7, 0, "user", said, ""), (-7, 1, "assistant", said, "")]
    for conv in range(40):
        made += [(conv, 0, "system", "be kind", ""), (conv, 1, "user", chance.choice(["hi", "hello é \U0001f642"]), "")]
        made += [(conv, 2 + k, chance.choice(["user", "assistant"]), chance.choice(["a", "b\n", " c  d", "", None, "<turn x>"]), "") for k in range(chance.randrange(5))]
    made += [(100, 0, "user", "same", ""), (100, 0, "user", "same", ""), (101, None, None, None, ""), (None, 3, "user", "no id", ""), (None, 1, "assistant", "first", "")]
    made += [(102, 0, "assistant", "long " * 50_000, "")] + [(103, k, "user", f"turn {k}", "") for k in range(300)]
    return made


def test_digests_of_all_conversations(spark, rows):
    got = format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == expected(rows)
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree(spark, rows):
    from tokenizers import Tokenizer

    folder = new_folder(spark)
    write_tree(spark.createDataFrame(rows, SCHEMA), folder)
    nodes = {r.node: r for r in spark.read.parquet(f"{folder}/nodes").collect()}
    turns = spark.read.parquet(f"{folder}/turns").collect()
    paths = {}
    for t in sorted(turns, key=lambda t: (str(t.conv_id), t.nth)):
        paths.setdefault(t.conv_id, []).append(nodes[t.node])
    # Shared first turns are one node.
    assert len({p[1].node for c, p in paths.items() if c is not None and 0 <= c < 40}) == 2
    at = 0
    for n in sorted(nodes.values(), key=lambda n: n.first_token):
        assert n.first_token == at
        at += len(n.ids)
    tokenizer = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    row = {n.first_token + k: i for n in nodes.values() for k, i in enumerate(n.ids)}
    for path in paths.values():
        before = []
        for n, parent in zip(path, [None, *path], strict=False):
            assert n.parent == (parent and parent.node)
            # What a node's tokens see before their own is the conversation up to there.
            seen = [row[k] for i in n.intervals for k in range(i["from"], i["to"])]
            assert seen == before and n.position == len(before)
            before += n.ids
        # Depth first: a path's nodes come in order, and nothing foreign lies between the first child and its parent.
        firsts = [n.first_token for n in path]
        assert firsts == sorted(firsts)
    learned = [tokenizer.decode(n.ids[n.loss_from : n.loss_to], skip_special_tokens=False) for n in nodes.values() if n.role == "assistant"]
    assert "long " * 50_000 in learned and all(n.loss_from == n.loss_to for n in nodes.values() if n.role != "assistant")


def test_a_turn_carries_no_path(spark):
    turns = chat.paths(spark.range(1500).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "'hi' AS text")).collect()
    assert len({t.node for t in turns}) == 1500
    assert max(sum(len(v) for v in t if isinstance(v, str)) for t in turns) < 100


def test_batches_end_by_bytes():
    batches = list(chat._batches(iter([("x" * 1_000_000,)] * 100), pa.schema([("text", pa.string())])))
    assert sum(b.num_rows for b in batches) == 100 and max(b.nbytes for b in batches) < 10_000_000


def test_chains_on_chains_lie_depth_first(spark):
    chance = random.Random(4)
    said = [[f"t{k}" for k in range(3)]]
    for conv in range(1, 60):  # each goes on from one before; every fourth from the last, so that they hang deep
        before = said[-1] if conv % 4 else chance.choice(said)
        said.append(before[: chance.randrange(len(before) + 1) if conv % 9 == 0 else len(before) - conv % 2] + [f"c{conv}", f"d{conv % 7}"])
    made = [(c if c else None, k, "user", t, "") for c, turns in enumerate(said) for k, t in enumerate(turns)]
    folder = new_folder(spark)
    write_tree(spark.createDataFrame(made, SCHEMA).repartition(7), folder)
    nodes = sorted(spark.read.parquet(f"{folder}/nodes").collect(), key=lambda n: n.first_token)
    assert len(nodes) == len({tuple(t[: k + 1]) for t in said for k in range(len(t))})
    at, open_nodes = 0, []
    for n in nodes:
        assert n.first_token == at
        at += len(n.ids)
        while open_nodes and open_nodes[-1] != n.parent:
            open_nodes.pop()  # a subtree is left for good, so its nodes never come as parents again
        assert bool(open_nodes) == (n.parent is not None)
        open_nodes.append(n.node)
