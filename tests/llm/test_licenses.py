from __future__ import annotations

import random
import re

import pytest

from storelens.llm.licenses import BASE, RESULT, automaton, evaluate, scan, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text: str) -> tuple:
    """Words, places and labels of the base phrases, by trying every word."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lower)
    places, labels = [], set()
    for phrase, label in BASE.items():
        wanted = phrase.split()
        for at in range(len(words)):
            if words[at : at + len(wanted)] == wanted:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_as_by_hand():
    got = scan("The MIT License, and: mit\nlicense. GNU General-Public License", automaton())
    assert got[:5] == (10, 3, 1, 7, "gpl,mit")


def test_random_texts_match_brute_force():
    chance = random.Random(5)
    parts = ["mit", "license", "License", "apache", "general", "public", "lesser", " ", ", ", "\n", "é", "2", "mit license", "_", "cc by nc"]
    phrases = automaton()
    for _ in range(2000):
        text = "".join(chance.choice(parts) + chance.choice(["", " "]) for _ in range(chance.randrange(25)))
        assert scan(text, phrases)[:5] == plain(text), text


@pytest.mark.parametrize("text, reads, labels, permissive", [
    ("MIT", "MIT", {"mit"}, True),
    ("MIT OR GPL-2.0-only AND BSD-3-Clause", "(MIT OR (GPL-2.0-only AND BSD-3-Clause))", {"mit", "gpl", "bsd"}, True),
    ("(MIT OR Apache-2.0) AND GPL-3.0-or-later", "((MIT OR Apache-2.0) AND GPL-3.0-or-later)", {"mit", "apache", "gpl"}, False),
    ("GPL-2.0-only WITH Classpath-exception-2.0 or mit */", "(GPL-2.0-only WITH Classpath-exception-2.0 OR mit)", {"gpl", "mit"}, True),
    ("LicenseRef-Own", "LicenseRef-Own", {"licenseref-own"}, False),
])
def test_expressions(text, reads, labels, permissive):
    value = evaluate(text)
    assert (value.text, set(value.labels), value.permissive) == (reads, labels, permissive)


@pytest.mark.parametrize("text", ["", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT Apache-2.0", "()", "MIT AND OR BSD"])
def test_broken_expressions(text):
    assert evaluate(text) is None


def test_rows(spark):
    text = "x\n// SPDX-License-Identifier: MIT OR GPL-2.0\nAll rights reserved. Licensed under the Apache License"
    rows = [(1, None, 7), (2, "", 7), (3, text, 7), (3, text, 7), (None, "word " * 50_000 + "MIT License", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = sorted(scan_licenses(docs, "doc_id").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert tuple(got[0])[1:] == (0, 0, None, None, "", "", 0.0, None, None) == tuple(got[1])[1:]
    assert got[2] == got[3]
    assert (got[2].base_labels, got[2].labels) == ("apache", "all-rights-reserved,apache,gpl,mit")
    assert (got[2].expressions, got[2].permissive, got[2].score) == ("(MIT OR GPL-2.0)", True, 1 - 1 / 16)
    assert (got[4].n_words, got[4].first_word) == (50_002, 50_000)
    assert scan_licenses(docs.limit(0), "doc_id").count() == 0
    assert scan_licenses(docs, "doc_id").columns == ["doc_id", *[p.split()[0] for p in RESULT.split(", ")]]
