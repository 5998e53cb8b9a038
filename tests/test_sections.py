import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.functions.text import split_recursively
from storelens.lookups import CHUNK_SEPARATORS, HEADING, MIN_FRAGMENT_CHARS, SECTION_BREAK
from storelens.operators import sections
from storelens.sources import documents
from storelens.sources.warehouse import policy_pages
from tests.conftest import final_plan, rows

LONG = "El cliente puede solicitar el cambio dentro del plazo indicado por la tienda en línea. "
PAGES = [
    ("programa_afiliados", 1, "Bienvenida. " + LONG + "\n5. Plazos de solicitud\n" + LONG + "\n5.1 Retracto\n" + LONG),
    ("programa_afiliados", 2, LONG + "\n6. Corto\n7. Garantía\n" + LONG * 15),
    ("programa_afiliados", 3, "\n\n  " + LONG + "\n8 minúscula " + LONG + "\n9. ¿Preguntas?\n" + LONG),
    ("guia_nueva", 1, LONG),
    ("guia_nueva", 2, "12.3. «Envíos» " + LONG),
    ("guia_nueva", 3, "corto"),
    ("guia_nueva", 4, LONG + LONG),
]


L = LONG.strip()
LISTED = "12.3. «Envíos» " + L[:71]  # a heading is a number and 80 characters at most
BODIES = [
    ("programa_afiliados", 1, "Introducción", "Introducción\nBienvenida. " + L),
    ("programa_afiliados", 1, "5. Plazos de solicitud", "5. Plazos de solicitud\n" + L),
    ("programa_afiliados", 1, "5.1 Retracto", "5.1 Retracto\n" + L),
    ("programa_afiliados", 2, "5.1 Retracto", "5.1 Retracto\n" + L),
    ("programa_afiliados", 2, "7. Garantía", "7. Garantía\n" + LONG * 14 + L),
    ("programa_afiliados", 3, "7. Garantía", "7. Garantía\n" + LONG + "\n8 minúscula " + L),
    ("programa_afiliados", 3, "9. ¿Preguntas?", "9. ¿Preguntas?\n" + L),
    ("guia_nueva", 1, "Introducción", "Introducción\n" + L),
    ("guia_nueva", 2, LISTED, "12.3. «Envíos» " + L),
    ("guia_nueva", 4, LISTED, LISTED + "\n" + LONG + L),
]


def bodies_of(spark, pages, **options):
    df = spark.createDataFrame(pages, "doc_stem string, page_no int, text string")
    return sections.section_bodies(sections.section_fragments(df, **options))


@pytest.mark.parametrize("pages_per_block", [512, 2, 1])
def test_sections_of_hand_made_pages(spark, pages_per_block):
    # The short "6. Corto" and "corto" are dropped; the former never becomes the section.
    got = rows(bodies_of(spark, PAGES, pages_per_block=pages_per_block), "doc_stem", "page_no", "section", "body")
    assert sorted(got) == sorted(BODIES)


def test_carry_over_many_blocks_of_random_documents(spark):
    """Documents are made of sections with a page per paragraph, so what section a
    paragraph is in is known from the start. Some pages are missing."""
    rng = random.Random(3)
    pages, want = [], []
    for stem in ("a", "b", "c"):
        numbers = iter(sorted(rng.sample(range(1, 200), 120)))
        for n in range(20):
            section = f"{rng.randint(1, 99)}. Tema {n}" if n else "Introducción"
            for k in range(rng.randint(1, 6)):
                page, paragraph = next(numbers), f"Párrafo {n} {k}: {L}"
                headed = f"{section}\n{paragraph}"
                pages.append((stem, page, headed if n and not k else paragraph + "\n3. Corto"))
                want.append((stem, page, section, headed))
    for pages_per_block in (3, 7):
        got = rows(bodies_of(spark, pages, pages_per_block=pages_per_block), "doc_stem", "page_no", "section", "body")
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n_pages", [3, 2000])
def test_one_plan_reads_the_text_once(spark, tmp_path, n_pages):
    """The same plan for a short and a long document, made without a job: one scan, one shuffle of the text."""
    pages = [("d", n, ("5. Plazos\n" if n == 2 else "") + LONG) for n in range(1, n_pages + 1)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(pages, "doc_stem string, page_no int, text string").write.parquet(path)
    stored = spark.read.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    fragments = sections.section_fragments(stored)
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("running", "running")
    got = {r["page_no"]: r["section"] for r in fragments.collect()}
    assert got == {n: "Introducción" if n < 2 else "5. Plazos" for n in range(1, n_pages + 1)}
    final = final_plan(fragments).split("== Initial Plan ==")[0].split("== Physical Plan ==")[1]
    assert final.count("FileScan") == 1
    # At run time the join goes where no block has one before it.
    assert final.count("ReusedExchange") == (n_pages > sections.PAGES_PER_BLOCK)


def test_fragment_counts_on_driver_tables(spark):
    fragments = sections.section_fragments(policy_pages(spark, "/root/testdata/sf0.001"))
    default = fragments.where("section = 'Introducción'").count()
    assert (fragments.count(), fragments.where("heading is not null").count(), default) == (618, 422, 119)


# ---- recursive splitting --------------------------------------------------------


def test_split_prefers_coarse_marks():
    text = "aaaa\n\nbbbb\n\ncccc"
    assert split_recursively(text, 12, 0, CHUNK_SEPARATORS) == ["aaaa\n\nbbbb", "cccc"]
    assert split_recursively("one two three four", 9, 4, CHUNK_SEPARATORS) == ["one two", "three", "four"]
    assert split_recursively("a b c d e f", 5, 3, CHUNK_SEPARATORS) == ["a b c", "c d", "d e", "e f"]
    assert split_recursively("abcdefghij", 4, 1, CHUNK_SEPARATORS) == ["abcd", "defg", "ghij"]


def test_split_goes_finer_only_where_needed():
    text = "short.\n\n" + "word " * 10 + "\n\nend."
    pieces = split_recursively(text, 20, 0, CHUNK_SEPARATORS)
    assert pieces[0] == "short." and pieces[-1] == "end."
    assert all(len(p) <= 20 for p in pieces)


@settings(max_examples=150, deadline=None)
@given(
    st.text(alphabet="ab \n.é", max_size=300),
    st.integers(min_value=4, max_value=40).flatmap(lambda s: st.tuples(st.just(s), st.integers(0, s // 2))),
)
def test_split_keeps_every_character_in_order(text, limits):
    size, overlap = limits
    pieces = split_recursively(text, size, overlap, CHUNK_SEPARATORS)
    assert all(0 < len(p) <= size and p == p.strip() for p in pieces)
    letters = lambda s: re.sub(r"\s", "", s)
    whole, covered = letters(text), 0
    for piece in map(letters, pieces):
        at = whole.rfind(piece, 0, covered + len(piece))
        assert at >= 0
        covered = max(covered, at + len(piece))
    assert covered == len(whole)


def test_chunks_keep_their_heading(spark):
    bodies = bodies_of(spark, PAGES)
    chunks = sections.recursive_chunks(bodies).collect()
    want = {(b[0], b[1], b[3]) for b in rows(bodies, "doc_stem", "page_no", "section", "body")}
    for stem, page, body in want:
        mine = [c for c in chunks if (c["doc_stem"], c["page_no"]) == (stem, page) and body.startswith(c["section"])]
        if len(body) <= 1000:
            assert body in [c["text"] for c in mine]
    long_ones = [c for c in chunks if c["section"] == "7. Garantía"]
    assert len(long_ones) > 1
    assert all(c["text"].startswith("7. Garantía") for c in long_ones)
    pieces = split_recursively(next(b for _, _, b in want if b.startswith("7. Garantía\n") and len(b) > 1000), 1000, 150, CHUNK_SEPARATORS)
    longest = [c for c in long_ones if c["page_no"] == 2]
    assert [c["text"] for c in sorted(longest, key=lambda c: c["piece"])] == [
        p if p.startswith("7. Garantía") else "7. Garantía\n" + p for p in pieces
    ]


def test_chunks_of_the_whole_corpus(spark):
    """Every long line of a page is found in its page's chunks, in order, under the nearest heading before it."""
    pages = policy_pages(spark, "/root/testdata/sf0.001")
    chunks = {}
    for c in sections.policy_chunks(pages).collect():
        chunks.setdefault((c["title"], c["page_label"]), []).append((int(c["passage_id"].split("#")[2]), int(c["passage_id"].split("#")[3]), c["section"], c["text"]))
    heading = re.compile(HEADING)
    checked = 0
    for r in pages.collect():
        own = sorted(chunks.get((r["doc_stem"], r["page_no"]), []))
        assert all(len(text) <= 1000 + len(section) + 1 for _, _, section, text in own)
        # Only a body that was split may begin with a shorter piece, such as its heading alone.
        split = {pos for pos, piece, _, _ in own if piece}
        assert all(len(text) >= MIN_FRAGMENT_CHARS for pos, piece, _, text in own if piece == 0 and pos not in split)
        place, nearest = -1, None
        for line in map(str.strip, r["text"].split("\n")):
            # Only a line that opens a fragment brings a heading; none of these pages begins with one.
            if re.search(SECTION_BREAK, "\n" + line) and heading.match(line):
                nearest = heading.match(line)[1].strip()
            if MIN_FRAGMENT_CHARS <= len(line) <= 150:
                # Only a body that was split may have cut a line.
                found = [k for k, c in enumerate(own) if line in c[3]]
                if not found:
                    assert any(c[1] > 0 for c in own)
                    continue
                assert found[-1] >= place
                place = found[0]
                if nearest and len(nearest) >= MIN_FRAGMENT_CHARS:
                    # A line may stand under several headings.
                    assert nearest in {own[k][2] for k in found}
                checked += 1
    assert checked > 100


def test_titles_and_ids(spark):
    pages = spark.createDataFrame(PAGES, "doc_stem string, page_no int, text string")
    chunks = sections.policy_chunks(pages)
    assert {r[0] for r in rows(chunks, "title")} == {"Programa de Afiliados", "guia_nueva"}
    assert chunks.select("passage_id").distinct().count() == chunks.count()


# ---- fixed windows, files -------------------------------------------------------


def test_fixed_windows(spark):
    texts = {1: "", 2: "abc", 3: "0123456789" * 3, 4: "añ😀b\nc" * 7, 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = sorted(rows(sections.fixed_window_chunks(df, size=10, overlap=3), "doc_id", "start", "text"))
    want = [(i, s, t[s:s + 10]) for i, t in texts.items() if t for s in range(0, len(t), 7)]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        sections.fixed_window_chunks(df, size=10, overlap=6)


def test_pages_from_files_and_chunk_store(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "faq_metodos_pago.txt").write_text("uno\ndos\ftres", encoding="utf-8")
    (folder / "v1.2.txt").write_text("x", encoding="utf-8")
    pages = documents.read_pages(spark, str(folder))
    assert sorted(rows(pages)) == [("faq_metodos_pago", 1, "uno\ndos"), ("faq_metodos_pago", 2, "tres"), ("v1.2", 1, "x")]

    store = str(tmp_path / "chunks")
    with pytest.raises(FileNotFoundError):
        documents.write_chunks(sections.policy_chunks(pages), store)
    made = sections.policy_chunks(spark.createDataFrame(PAGES, "doc_stem string, page_no int, text string"))
    documents.write_chunks(made, store)
    documents.write_chunks(made, store)
    assert spark.read.parquet(store).count() == made.count()
