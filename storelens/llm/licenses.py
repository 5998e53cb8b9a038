"""Licences named in whole texts: Aho-Corasick over phrases, shunting-yard over expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from storelens.llm.common import slices, texts_of

# Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Phrases that add a label but no counted place.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAGGED = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
# Beginnings of licence identifiers, longest first, with the label and whether its terms are permissive.
FAMILIES = (
    ("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("mit", "mit", True),
    ("apache", "apache", True), ("bsd", "bsd", True), ("isc", "isc", True), ("mpl", "mpl", False),
    ("epl", "epl", False), ("bsl", "bsl", True), ("cc0", "cc0", True), ("cc-by-nc", "cc-by-nc", False),
    ("cc-by-nd", "cc-by-nd", False), ("cc-by-sa", "cc-by-sa", False), ("cc-by", "cc-by", True), ("unlicense", "unlicense", True),
)

# Lower-case letters and digits stay, capitals become lower, other ASCII separates words;
# bytes of all other characters belong to words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions string, permissive boolean"
)


# ---- expressions ----------------------------------------------------------------

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:\-]+")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}


class Expression:
    """A licence or a combination: how it reads, its labels and whether permissive terms suffice."""

    __slots__ = ("labels", "permissive", "text")

    def __init__(self, text: str, labels: frozenset[str], permissive: bool) -> None:
        self.text, self.labels, self.permissive = text, labels, permissive


def _licence(name: str) -> Expression:
    for start, label, permissive in FAMILIES:
        if name.lower().startswith(start):
            return Expression(name, frozenset([label]), permissive)
    return Expression(name, frozenset([name.lower()]), False)


def _combine(operator: str, left: Expression, right: Expression) -> Expression:
    if operator == "WITH":  # an exception names no licence and only adds permissions
        return Expression(f"{left.text} WITH {right.text}", left.labels, left.permissive)
    free = left.permissive or right.permissive if operator == "OR" else left.permissive and right.permissive
    return Expression(f"({left.text} {operator} {right.text})", left.labels | right.labels, free)


def evaluate(text: str) -> Expression | None:
    """The expression's value by two stacks, WITH before AND before OR, equals from the left.

    None if it does not parse. Signs that no expression holds end it (`MIT */`).
    """
    tokens = []
    at = 0
    text = text.strip()
    while at < len(text) and (found := _TOKEN.match(text, at)):
        tokens.append(found[0])
        at = found.end()
        while at < len(text) and text[at] in " \t":
            at += 1
    values: list[Expression] = []
    operators: list[str] = []

    def apply() -> bool:
        if len(values) < 2:
            return False
        right = values.pop()
        values.append(_combine(operators.pop(), values.pop(), right))
        return True

    wants_value = True
    for token in tokens:
        if token == "(":
            if not wants_value:
                return None
            operators.append(token)
        elif token == ")":
            if wants_value:
                return None
            while operators and operators[-1] != "(":
                if not apply():
                    return None
            if not operators:
                return None
            operators.pop()
        elif token.upper() in _RANK:
            if wants_value:
                return None
            rank = _RANK[token.upper()]
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= rank:
                if not apply():
                    return None
            operators.append(token.upper())
            wants_value = True
        else:
            if not wants_value:
                return None
            values.append(_licence(token))
            wants_value = False
    if wants_value:
        return None
    while operators:
        if operators[-1] == "(" or not apply():
            return None
    return values[0]


# ---- scan -----------------------------------------------------------------------


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES, TAG):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, phrases) -> tuple:
    """The columns of RESULT for one text.

    The automaton runs over the text's words with one blank between them. The score grows
    with evidence: each place of a phrase halves what is missing to 1, each tag whose
    expression parses leaves a quarter.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    places: list[int] = []
    base, others = set(), set()
    missing = 1.0
    tagged = False
    word = counted_to = 0
    for end, phrase in phrases.iter(line):
        if phrase == TAG:
            tagged = True
            continue
        missing /= 2
        if phrase in BASE:
            start = end - len(phrase) - 1
            # Blanks before a word count the words before it; matches come by their end.
            word = word + line.count(" ", counted_to, start) if start >= counted_to else line.count(" ", 0, start)
            counted_to = start
            places.append(word)
            base.add(BASE[phrase])
        else:
            others.add(NOTICES[phrase])
    parsed = [e for m in TAGGED.finditer(text) if (e := evaluate(m[1]))] if tagged else []
    for expression in parsed:
        others |= expression.labels
        missing /= 4
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | others)), 1 - missing, "; ".join(e.text for e in parsed) or None,
        all(e.permissive for e in parsed) if parsed else None,
    )


def scan_licenses(docs: DataFrame, *kept: str) -> DataFrame:
    """`kept` columns and RESULT for every row.

    A NULL or empty text has no words, no places, empty label texts and score 0; repeated
    rows are all kept; other columns, whatever their names, are left out.
    """
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
    names = [part.split()[0] for part in RESULT.split(", ")]
    kinds = [docs.schema[k].simpleString().replace(":", " ", 1) for k in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        for batch in slices(batches):
            found: Sequence[tuple] = [scan(t, phrases) for t in texts_of(batch).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *columns], names=[*kept, *names])

    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*kinds, RESULT]))
