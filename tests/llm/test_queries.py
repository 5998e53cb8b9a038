"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from storelens.llm import decontamination, similarity
from storelens.llm.common import table, written
from storelens.llm.queries import ORACLES, QUERIES
from tests.llm.test_decontamination import distance
from tests.llm.test_packing import check
from tests.llm.test_similarity import brute
from tests.llm.test_tokens import whole
from verification.compare import duck

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # enough labels to learn from

COLUMNS = {
    1: ["doc_id", "start", "n_tokens", "ids_crc32"],
    2: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    3: ["doc_id", "held_out", "score", "predicted"],
    5: ["query_id", "rank", "vec_id", "score"],
    7: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    8: ["doc_id", "held_out", "lang_pred", "score"],
    9: ["doc_id", "held_out", "score", "predicted"],
    11: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    12: ["lang", "source", "part", "item", "value", "rank"],
    13: ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    10: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    got = QUERIES[name](spark, SF)
    wanted = COLUMNS.get(int(name[2:].split("_")[0]), ["doc_id"])
    assert got.columns[: len(wanted)] == wanted
    assert got.count() > 0


def test_oracles(spark):
    con = duck(SF)
    for name, sql in ORACLES.items():
        con.execute(sql)
        names = [d[0] for d in con.description]
        assert sorted(con.fetchall()) == sorted(tuple(r[c] for c in names) for r in QUERIES[name](spark, SF).collect())


def test_near_duplicates_by_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = similarity.near_duplicates(table(spark, SF, "documents")).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got} == brute(rows)


def test_decontamination_by_brute_force(spark):
    """Every item that stands in a text, as folded, is found; every place found is near its item."""
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}

    def fold(text: str) -> str:
        return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())

    got = decontamination.find_passages(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()
    folded = {k: fold(t) for k, t in docs.items()}
    exact = {(d, i) for d, t in folded.items() for i, b in items.items() if f" {fold(b)} " in f" {t} "}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in got}
    for r in got:
        assert distance(fold(docs[r.doc_id][r.start : r.end]), fold(items[r.item_id])) <= max(r.edits, 0.1 * len(items[r.item_id]))


def test_pipeline(spark):
    docs = table(spark, LARGER, "documents")
    rows = docs
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, LARGER)
        assert rows.schema == docs.schema
        kept = {r.doc_id for r in rows.collect()}
        assert kept < {r.doc_id for r in before.collect()}
        left.append(kept)
        rows = written(rows)
    labels = table(spark, LARGER, "labels").collect()
    clean = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    assert len(clean & left[1]) >= 0.97 * len(clean)
    texts = [tuple(r) for r in rows.select("doc_id", "text").collect()]
    assert all(links == 0 and copies == 1 for _, links, copies in brute(texts).values())
    assert decontamination.find_passages(rows, table(spark, LARGER, "benchmark")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, LARGER).collect()
    sizes = check(packed, {i: [whole(t)] for i, t in texts}, 2048)
    assert all(n & (n - 1) == 0 for n in sizes)
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, LARGER).collect()))


def test_the_rest_imports_without_this_part(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for name in ("storelens", "verification"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60, check=True)
    assert done.stdout.split() == [str(len(entry.queries()) - 14), "False"]
