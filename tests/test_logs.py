import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storelens.operators import evaluation, team
from storelens.schema import INTERACTIONS, RUNS
from storelens.sources import logs
from tests.conftest import rows

T0 = datetime(2026, 7, 20, 12, 0, 0)


def test_interaction_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read_interactions(spark, path).count() == 0
    assert logs.read_interactions(spark, path).schema == INTERACTIONS
    batch = spark.createDataFrame(
        [(T0, "¿cuántos?", ["top_products"], 1.23456, 10, 5, 15), (T0, "hi", None, None, None, None, None)], INTERACTIONS
    )
    logs.append_interactions(batch, path)
    logs.append_interactions(batch.limit(1), path)
    stored = logs.read_interactions(spark, path)
    assert sorted(rows(stored, "question", "tools", "latency_s", "total_tokens"), key=str) == sorted([
        ("¿cuántos?", ["top_products"], 1.23, 15), ("¿cuántos?", ["top_products"], 1.23, 15), ("hi", [], None, 0),
    ], key=str)
    assert {r[0] for r in rows(stored, "ts")} == {T0}
    line = json.loads(spark.read.text(path).where("value like '%cuántos%'").first()[0])
    assert line["ts"] == "2026-07-20T12:00:00+00:00"


def run(i, trace, root, name="tool_a", start=T0, end=T0 + timedelta(seconds=2.5), inputs=None, **more):
    row = dict(id=i, trace_id=trace, name=name, run_type="chain" if root else "tool", is_root=root, start_time=start,
               end_time=end, total_tokens=7, error=None, inputs=inputs, outputs=None)
    row.update(more)
    return tuple(row[f.name] for f in RUNS)


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([
        run("1", "t1", True, inputs="{'content': 'top sellers?\\n\\n[System note: reply]'}"),
        run("2", "t1", False, "top_products"),
        run("3", "t1", False, "top_products"),
        run("4", "t1", False, "list_orders"),
        run("5", "t2", True, inputs='{"content": "' + "x" * 200 + '"}', end=None, outputs="o" * 900),
        run("6", "t3", True, inputs="nothing to see", start=T0 - timedelta(days=20)),
        run("7", "t4", True, inputs=None, start=T0 - timedelta(days=14)),
        run("8", "t9", False, "returns_report"),
    ], RUNS)


def test_trace_archive(runs, spark, tmp_path):
    archive = logs.trace_archive(runs)
    got = {r["id"]: r for r in archive.collect()}
    # Exactly fourteen days back is still in.
    assert sorted(got) == ["1", "5", "7"]
    assert (got["1"]["latency_s"], got["5"]["latency_s"], len(got["5"]["output"])) == (2.5, None, 500)
    assert logs.trace_archive(runs, days=30).count() == 4
    later = F.lit(T0 + timedelta(days=40))
    assert logs.trace_archive(runs, as_of=later).count() == 0

    path = str(tmp_path / "archive")
    logs.write_trace_archive(archive, path, "2026-07-20")
    logs.write_trace_archive(archive, path, "2026-07-27")
    logs.write_trace_archive(archive.limit(1), path, "2026-07-27")
    stored = spark.read.json(path).groupBy("export_date").count()
    assert {str(r[0]): r[1] for r in stored.collect()} == {"2026-07-20": 3, "2026-07-27": 1}


def test_trace_tools(runs):
    got = {r["trace_id"]: [tuple(t) for t in r["tools"]] for r in team.trace_tools(runs).collect()}
    assert got == {"t1": [("list_orders", 1), ("top_products", 2)], "t2": [], "t3": [], "t4": []}


def test_trace_questions(runs):
    got = rows(team.traced_interactions(runs, days=None), "question")
    assert sorted(got) == [("top sellers?",), ("x" * 160,)]


def test_union_keeps_duplicates_and_bounds_traces_only(spark, runs):
    log = spark.createDataFrame(
        [(T0 - timedelta(days=400), "top sellers?", ["top_products", "top_products"]), (T0, None, None)],
        "ts timestamp, question string, tools array<string>",
    )
    both = team.all_interactions(log, runs)
    assert both.count() == 4
    assert rows(team.team_questions(both, 1)) == [("top sellers?", 2)]
    assert rows(team.team_topics(both)) == [("Sales & products", 4, 0.8), ("Other", 1, 0.2)]
    late = F.lit(T0 + timedelta(days=100))
    assert team.all_interactions(log, runs, as_of=late).count() == 2


def test_no_tools_no_topics(spark):
    empty = spark.createDataFrame([("q", [])], f"question string, tools {team.TOOL_CALLS}")
    assert rows(team.team_topics(empty)) == []


def test_one_trace_with_most_of_the_runs(spark):
    """A third of all runs in one trace becomes one entry per distinct tool."""
    tools = ["a", "b", "c"]
    runs = spark.range(30000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") < 10000, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5000)).alias("trace_id"),
        F.element_at(F.array(*map(F.lit, tools)), (F.col("id") % 3 + 1).cast("int")).alias("name"),
        F.lit("tool").alias("run_type"), F.lit(False).alias("is_root"),
        F.lit(T0).alias("start_time"), F.lit("").alias("inputs"),
    )
    roots = spark.createDataFrame(
        [("r", "hot", "agent", "chain", True, T0, "")],
        "id string, trace_id string, name string, run_type string, is_root boolean, start_time timestamp, inputs string",
    )
    got = team.trace_tools(runs.unionByName(roots)).collect()
    assert [tuple(t) for t in got[0]["tools"]] == list(Counter(tools[i % 3] for i in range(10000)).items())


def test_token_usage(spark):
    messages = spark.createDataFrame(
        [(1, 10, 5), (1, None, 7), (2, None, None)], "interaction_id long, input_tokens long, output_tokens long"
    )
    assert sorted(rows(team.token_usage(messages))) == [(1, 10, 12, 22), (2, 0, 0, 0)]


def test_content_text(spark):
    blocks = json.dumps([{"type": "text", "text": " Hola "}, {"type": "sig", "extras": {"a": 1}}, {"text": "x"}])
    typed = {
        ("plain ", False): "plain ",
        ("[1, 2]", False): "[1, 2]",
        ('["{curly} text"]', False): '["{curly} text"]',
        (blocks, True): "Hola x",
        (json.dumps(["a", "b "]), True): "ab",
        (json.dumps(["{curly} text", {"text": "!"}, 3]), True): "{curly} text!3",
        ("[]", True): "",
        ("[not json", True): "[not json",
        (None, True): None,
    }
    df = spark.createDataFrame([*typed], "c string, is_list boolean")
    assert [r[0] for r in df.select(team.content_text("c", F.col("is_list"))).collect()] == list(typed.values())
    untyped = {"[1, 2]": "[1, 2]", '["{curly} text"]': '["{curly} text"]', blocks: "Hola x", "[]": "[]", '[{"text": "a"}, "b"]': '[{"text": "a"}, "b"]'}
    df = spark.createDataFrame([(c,) for c in untyped], "c string")
    assert [r[0] for r in df.select(team.content_text("c")).collect()] == list(untyped.values())


def test_parse_verdicts(spark):
    cases = [
        ('{"verdict": "PASS", "reason": "ok"}', ("PASS", "ok")),
        (' ```json\n{"verdict": "FAIL", "reason": "no"}\n``` ', ("FAIL", "no")),
        ('```{"verdict": "PARTIAL", "reason": "some"}```', ("PARTIAL", "some")),
        ('{"verdict": "GREAT", "reason": "ok"}', ("NEEDS_REVIEW", 'unparseable judge reply: {"verdict": "GREAT", "reason": "ok"}')),
        ("I think PASS", ("NEEDS_REVIEW", "judge error: I think PASS")),
        ("", ("NEEDS_REVIEW", "judge error: ")),
        (None, ("NEEDS_REVIEW", "judge error: ")),
        ("y" * 90, ("NEEDS_REVIEW", "judge error: " + "y" * 60)),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, reply string")
    got = rows(evaluation.parse_verdicts(df).orderBy("id"), "verdict", "reason")
    assert got == [c[1] for c in cases]


def test_verdict_table(spark):
    gold = spark.createDataFrame([(1, "docs", "q1"), (2, "api", "q2"), (3, "api", "q3")], "id int, category string, question string")
    answers = spark.createDataFrame(
        [(1, "a1", 1.26, None, '{"verdict": "PASS", "reason": "ok"}'), (2, "lost", 9.0, "e" * 200, None), (3, "a3", 2.0, "", "hm")],
        "id int, answer string, elapsed_s double, error string, reply string",
    )
    got = rows(evaluation.verdict_table(gold, answers).orderBy("id"))
    assert got == [
        (1, "docs", "q1", "a1", 1.3, "PASS", "ok"),
        (2, "api", "q2", "", 9.0, "ERROR", "e" * 120),
        (3, "api", "q3", "a3", 2.0, "NEEDS_REVIEW", "judge error: hm"),
    ]


def test_verdict_tables(spark, tmp_path):
    verdicts = spark.createDataFrame(
        [(1, "docs", "PASS"), (2, "docs", "FAIL"), (3, "api", "PASS"), (4, "api", "ERROR")],
        "id int, category string, verdict string",
    )
    assert rows(evaluation.verdict_counts(verdicts)) == [
        ("PASS", 2, 0.5), ("PARTIAL", 0, 0.0), ("FAIL", 1, 0.25), ("ERROR", 1, 0.25), ("NEEDS_REVIEW", 0, 0.0),
    ]
    assert rows(evaluation.pass_by_category(verdicts)) == [("api", 1, 2), ("docs", 1, 2)]
    assert {r[2] for r in rows(evaluation.verdict_counts(verdicts.limit(0)))} == {None}
    path = str(tmp_path / "verdicts")
    logs.write_verdicts(verdicts, path, "run1")
    logs.write_verdicts(verdicts.limit(2), path, "run2")
    logs.write_verdicts(verdicts.limit(3), path, "run2")
    assert sorted(rows(spark.read.parquet(path).groupBy("run_id").count())) == [("run1", 4), ("run2", 3)]


def test_gold_questions(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"description": "d", "questions": [
        {"id": 1, "lang": "es", "category": "docs", "question": "¿q?", "expected": "e", "source": "s"},
        {"id": 2, "lang": "en", "category": "api", "question": "q", "expected": "e"},
    ]}, indent=2), encoding="utf-8")
    assert rows(logs.read_gold_questions(spark, str(path)), "id", "question", "source") == [(1, "¿q?", "s"), (2, "q", None)]
