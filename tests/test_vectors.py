import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens import call
from storelens.lookups import NO_PASSAGES
from storelens.operators import vectors
from storelens.operators.sections import policy_chunks
from storelens.plans.policy_index import build_index
from tests.conftest import rows
from tests.test_sections import PAGES

SCHEMA = "passage_id long, embedding array<float>"


def toy_encoder(texts):
    """Letter counts: enough to tell texts apart without a model."""
    return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz:"] for t in texts], dtype="float32")


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 16)).astype("float32")
    data[100:110] = data[0]
    return data


@pytest.fixture(scope="module")
def passages(spark, corpus):
    made = [(i, v.tolist()) for i, v in enumerate(corpus)] + [(999, None)]
    return spark.createDataFrame(made, SCHEMA).repartition(7)


def brute(corpus, question, k):
    scores = np.round(corpus.astype("float64") @ np.array(question), 9)
    order = sorted(range(len(corpus)), key=lambda i: (-scores[i], i))[:k]
    return [(r, i, scores[i]) for r, i in enumerate(order, 1)]


@pytest.mark.parametrize("k", [1, 5, 37, 1000])
def test_top_passages_equal_brute_force(passages, corpus, k):
    rng = np.random.default_rng(9)
    # The first question meets eleven equal vectors: they rank by key.
    questions = [("same", corpus[0].astype("float64").tolist())] + [(f"q{i}", rng.normal(size=16).tolist()) for i in range(4)]
    got = {}
    for r in vectors.top_passages(passages, questions, k).orderBy("question", "rank").collect():
        got.setdefault(r["question"], []).append((r["rank"], r["passage_id"], r["score"]))
    for name, q in questions:
        assert got[name] == [(r, i, pytest.approx(s)) for r, i, s in brute(corpus, q, k)]


def test_small_batches(spark, passages, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        q = corpus[0].astype("float64").tolist()
        got = rows(vectors.top_passages(passages, [("q", q)], 9).orderBy("rank"), "passage_id")
        assert [g[0] for g in got] == [i for _, i, _ in brute(corpus, q, 9)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_questions_need_names(passages):
    for bad in ([], [("q", [0.0] * 16), ("q", [1.0] * 16)]):
        with pytest.raises(ValueError, match="distinct"):
            vectors.top_passages(passages, bad)


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "zz")], "passage_id long, text string")
    got = vectors.encode_column(df, toy_encoder).orderBy("passage_id").collect()
    for r in got:
        want = toy_encoder(["passage: " + (r["text"] or "")])[0]
        assert r["embedding"] == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-6)
    assert [r["text"] for r in got] == ["abc", None, "zz"]


def test_search_cites_the_nearest(spark):
    chunks = spark.createDataFrame(
        [("a", "zzzz zz", "Guía", 3), ("b", " bbbb bb\n", None, None), ("c", "cccc c", "FAQ", 1)],
        "passage_id string, text string, title string, page_label int",
    )
    indexed = vectors.encode_column(chunks, toy_encoder)
    got = rows(call("policy_search", indexed, "zz", toy_encoder, k=1))
    assert got == [("zz", "[Guía — p. 3]\nzzzz zz")]
    both = rows(call("search_policies", indexed, "bbbbbbbbbb", toy_encoder, k=2), "answer")[0][0].split("\n\n---\n\n")
    assert both[0] == "[Documento interno — p. ?]\nbbbb bb" and len(both) == 2
    assert rows(call("search_policies", indexed.limit(0), "zz", toy_encoder)) == [("zz", NO_PASSAGES)]


def test_citations_read_the_text_once_by_key(spark, passages, tmp_path):
    """The keys found are a condition of the one scan of the texts, so only their rows leave it."""
    path = str(tmp_path / "corpus")
    passages.withColumn("text", F.lit("t")).withColumn("title", F.lit("T")).withColumn("page_label", F.lit(1)).write.parquet(path)
    corpus = spark.read.parquet(path)
    nearest = vectors.top_passages(corpus, [("q", [1.0] * 16)])
    plan = vectors.format_passages(vectors.cited(nearest, corpus), [("q", [])])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "In(passage_id" in plan.split("PushedFilters")[1]


def test_build_and_search_an_index(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "doc_stem string, page_no int, text string")
    path = str(tmp_path / "index")
    n = build_index(pages, toy_encoder, path)
    index = spark.read.parquet(path)
    assert n == index.count() == policy_chunks(pages).count()
    stored = index.orderBy("passage_id").collect()
    question = vectors.encode_question("plazo de retracto", toy_encoder)
    scores = np.round(np.array([r["embedding"] for r in stored], dtype="float64") @ np.array(question), 9)
    first = stored[int(np.argmax(scores))]
    answer = rows(call("search_policies", index, "plazo de retracto", toy_encoder, k=2), "answer")[0][0]
    assert answer.startswith(f"[{first['title']} — p. {first['page_label']}]\n{first['text'].strip()}\n\n---\n\n")
    with pytest.raises(FileNotFoundError):
        build_index(pages.where("page_no > 99"), toy_encoder, path)
    assert spark.read.parquet(path).count() == n


def test_broken_vectors_are_left_out_and_harm_no_other(spark):
    nan, inf = float("nan"), float("inf")
    made = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [0.5, None]), (4, [inf, 1.0]), (5, [9.0]), (6, [9.0, 9.0, 9.0]), (7, []), (8, None), (9, [0.5, 0.5])]
    passages = spark.createDataFrame(made, SCHEMA).coalesce(1)
    got = rows(vectors.top_passages(passages, [("q", [1.0, 0.0]), ("r", [0.0, 1.0])]), "question", "rank", "passage_id")
    assert sorted(got) == [("q", 1, 1), ("q", 2, 9), ("r", 1, 9), ("r", 2, 1)]
    for bad in ([("q", [1.0]), ("r", [1.0, 0.0])], [("q", [nan, 0.0])], [("q", [])]):
        with pytest.raises(ValueError):
            vectors.top_passages(passages, bad)
