"""Toxicity, quality and language: learned parts by hand, the rest by held-out accuracy."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelens.llm import language, quality, toxicity
from storelens.llm.common import remainder_of_id, table
from storelens.llm.labelled import binned, cut_points, training_rows

LARGE = "/root/testdata/sf0.1"
SF = "/root/testdata/sf0.01"


# ---- learners -------------------------------------------------------------------


def test_isotonic_is_the_nearest_rising_function():
    chance = np.random.default_rng(3)
    margin = chance.normal(size=400)
    labels = (chance.random(400) < 1 / (1 + np.exp(-2 * margin))).astype(int)
    fitted = toxicity.Isotonic().fit(margin, labels)
    grid = fitted(np.linspace(-4, 4, 200))
    assert (np.diff(grid) >= 0).all() and grid.min() >= 0 and grid.max() <= 1
    assert np.abs(fitted(margin) - 1 / (1 + np.exp(-2 * margin))).mean() < 0.1


def test_trees_and_tables_learn_an_interaction():
    chance = np.random.default_rng(4)
    x = chance.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    assert ((toxicity.Trees().fit(x[:2000], y[:2000]).margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    model = quality.AdditiveModel().fit(x[:2000], y[:2000])
    assert (0, 1) == model.pairs[0]
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.9


def test_additive_margin_is_a_sum_of_table_entries():
    chance = np.random.default_rng(5)
    x = np.round(chance.random((500, 3)), 1)
    model = quality.AdditiveModel(rounds=20, pair_rounds=5).fit(x, (x[:, 0] + x[:, 1] > 1).astype(int))
    row = x[:1]
    total = model.base + sum(t[np.searchsorted(c, row[0, k])] for k, (t, c) in enumerate(zip(model.tables, model.cuts, strict=True)))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        total += t[np.searchsorted(model.pair_cuts[i], row[0, i]) * (model.pair_bins + 1) + np.searchsorted(model.pair_cuts[j], row[0, j])]
    assert abs(model.margin(row)[0] - total) < 1e-9


def test_bins():
    cuts = cut_points(np.array([1.0, 1.0, 2.0, 4.0]), 8)
    assert cuts.tolist() == [1.5, 3.0]
    assert binned(np.array([[0.0], [1.5], [3.1]]), [cuts]).ravel().tolist() == [0, 0, 2]


AWKWARD = ["", " ", "\n\n", "é", "!!!", "a", "word " * 30_000, "\U0001f642" * 50, "x\x00y", "A\n" * 400]


def test_features_are_finite_for_any_text():
    texts = pa.array(AWKWARD, pa.large_string())
    for made in (toxicity.features(texts, {"word": 2.0, "wor*": 1.0}), quality.features(texts)):
        assert np.isfinite(made).all() and len(made) == len(AWKWARD)
    assert toxicity.features(texts, {}).shape[1] == len(toxicity.FEATURES)
    assert quality.features(texts).shape[1] == len(quality.FEATURES)


def test_toxic_features_of_a_text():
    lexicon = {"idiot": 5.0, "lowei*": 4.0}
    made = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(["You are an IDIOT, 1d10t! loweisch far away from it all and"], pa.large_string()), lexicon)[0], strict=True))
    assert np.isclose(made["hits"], np.log(2)) and np.isclose(made["prefix_hits"], np.log(2)) and np.isclose(made["hidden"], np.log(2))
    assert np.isclose(made["near_second_person"], np.log(4)) and made["strongest"] == 5.0
    assert np.isclose(made["capital_words"], 1 / 12)


def test_training_rows_are_bounded_and_stable(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('t', id) AS text", "'x' AS label")
    labels = spark.range(60).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic").unionByName(
        spark.createDataFrame([(4, 1), (None, 1), (6, None)], "doc_id long, toxic int"))
    one = {(r.doc_id, r.label) for r in training_rows(docs, labels, "toxic", 20).collect()}
    two = {(r.doc_id, r.label) for r in training_rows(docs.repartition(7), labels.repartition(3), "toxic", 20).collect()}
    assert one == two and len(one) <= 20
    full = {r.doc_id: r.label for r in training_rows(docs, labels, "toxic", 1000).collect()}
    assert full[4] == 1 and full[6] == 0 and len(full) == 50


# ---- operators ------------------------------------------------------------------


@pytest.fixture(scope="module")
def learned(spark):
    docs = table(spark, SF, "documents").withColumn("held_out", remainder_of_id(5) == 0)
    labels = table(spark, SF, "labels")
    taught = docs.where(~F.col("held_out"))
    return docs.join(labels, "doc_id"), toxicity.train(taught, labels), quality.train(taught, labels)


def test_held_out_accuracy(learned):
    rows, toxic, good = learned
    for model, label, threshold in ((toxic, "toxic", 0.5), (good, "quality", 0.3)):
        got = toxicity.scored(rows, model, threshold, "doc_id", "held_out", label).where("held_out").collect()
        right = sum(r.predicted == r[label] for r in got)
        # Small tables: few of the toxic texts' rarer terms were seen in training.
        assert right >= 0.9 * len(got) and len(got) > 40
        if label == "quality":
            assert right >= 0.97 * len(got)
        else:
            assert all(r.predicted == 0 for r in got if r[label] == 0)


def test_toxic_rows_are_caught(spark):
    """On tables with enough of both kinds; always answering 0, or 1, or by chance, fails."""
    docs = table(spark, LARGE, "documents").withColumn("held_out", remainder_of_id(5) == 0)
    labels = table(spark, LARGE, "labels")
    model = toxicity.train(docs.where(~F.col("held_out")), labels)
    asked = docs.where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id")
    got = toxicity.scored(asked, model, 0.5, "doc_id", "toxic").collect()
    toxic, clean = ([r for r in got if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert len(clean) > 500 and sum(r.predicted for r in clean) <= 0.005 * len(clean)


def test_rows_of_any_kind_are_scored(spark, learned):
    _, toxic, good = learned
    rows = [(1, None, 9), (2, "", 9), (None, "some text here", 9), (4, "some text here", 9), (4, "some text here", 9), (5, "idiot scum you trash moron", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    for model in (toxic, good):
        got = toxicity.scored(docs.drop("score"), model, 0.5, "doc_id").collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id in (None, 4)}) == 1
        kept = toxicity.rows_by_score(docs, model, 0.5, keep_above=True)
        assert kept.schema == docs.schema
        assert kept.count() + toxicity.rows_by_score(docs, model, 0.5, keep_above=False).count() == 6
    assert toxicity.rows_by_score(docs.where("doc_id = 5"), toxic, 0.5, keep_above=True).count() == 1
    assert toxicity.scored(docs.limit(0), toxic, 0.5, "doc_id").count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, labels), 0.5, "doc_id").first().score == 0.0
    assert toxicity.scored(docs, quality.train(docs, labels), 0.3, "doc_id").first().predicted == 1


# ---- language -------------------------------------------------------------------


def test_grams_stay_within_texts():
    together = language.grams(["ab c1", "", "Ab-c", "x"], (1, 2, 3), 1 << 15)
    for at, text in enumerate(["ab c1", "", "Ab-c", "x"]):
        alone = language.grams([text], (1, 2, 3), 1 << 15)
        assert sorted(together[0][together[1] == at]) == sorted(alone[0])
    # Digits and signs are one blank, and case does not matter.
    assert sorted(language.grams(["ab1c"], (2,), 1 << 15)[0]) == sorted(language.grams(["AB -- c"], (2,), 1 << 15)[0])


def test_scores_match_counting_by_hand():
    texts = {"a": ["aab", "ab"], "b": ["bbb"]}
    counts = np.zeros((64, 2))
    for k, lang in enumerate(texts):
        for t in texts[lang]:
            np.add.at(counts[:, k], language.grams([t], (1, 2), 64)[0], 1)
    model = language.LanguageModel(["a", "b"], counts, (1, 2), 0.5)
    sums, n = model.scores(["abb"])
    expected = [sum(np.log((counts[g, k] + 0.5) / (counts[:, k].sum() + 32)) for g in language.grams(["abb"], (1, 2), 64)[0]) for k in (0, 1)]
    assert np.allclose(sums[0], expected, atol=1e-4) and n[0] == 5


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents").withColumn("held_out", remainder_of_id(3) == 1)
    model = language.train(docs.where(~F.col("held_out")))
    got = language.predict_languages(docs, model, "doc_id", "lang", "held_out").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(got)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 ?!", "x"), (4, "é", "x"), (None, "the thing was here", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    result = {r.doc_id: r for r in language.predict_languages(odd, model, "doc_id").collect()}
    assert [result[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [result[k].score for k in (1, 2, 3)] == [0.0] * 3
    assert result[4].lang_pred in {"de", "es", "fr"} and 0 < result[None].score <= 1
    none = language.train(spark.createDataFrame([("x", None), (None, "en")], "text string, lang string"))
    assert {r.lang_pred for r in language.predict_languages(odd, none, "doc_id").collect()} == {"und"}
    assert language.predict_languages(odd.limit(0), model, "doc_id").count() == 0


def test_long_text_scores_like_its_parts_say():
    chance = random.Random(1)
    words = ["haus", "und", "the", "of"]
    model = language.LanguageModel(["x", "y"], np.random.default_rng(1).random((1 << 15, 2)) * 9, (1, 2, 3), 0.5)
    text = " ".join(chance.choice(words) for _ in range(100_000))
    langs, scores = model.predict([text, ""])
    assert langs[0] in "xy" and langs[1] == "und" and scores.tolist()[1] == 0.0
