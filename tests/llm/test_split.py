from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.split import p2_found, p2_pieces, pieces
from tests.conftest import rows


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n", max_size=600), st.integers(30, 80))
def test_pieces_cover_and_stay_within_the_limit(text, limit):
    cut = pieces(text, limit, 12)
    assert "".join(text[s:e] for _, s, e in cut) == text.strip()
    assert all(e - b <= limit for b, _, e in cut)
    assert bool(cut) == bool(text.strip())
    assert (len(cut) > 1) == (len(text.strip()) > limit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=30, max_size=120))
def test_no_word_is_cut_where_there_are_blanks(words):
    text = " ".join(words)
    for back, start, end in pieces(text, 60, 12):
        assert end == len(text) or text[end - 1] == " "
        assert back == 0 or text[back - 1] == " "
        assert start - back <= 12


def test_strong_boundaries_first():
    text = "x" * 30 + ". " + "y" * 20 + "\n\n" + "z" * 50
    cut = pieces(text, 90, 10)
    assert text[cut[0][1] : cut[0][2]].endswith("\n\n")


def test_text_without_blanks_is_cut_hard_and_repeats_nothing():
    cut = pieces("x" * 500, 100, 20)
    assert all(b == s and e - s <= 80 for b, s, e in cut)


def test_queries(spark, tables):
    long = "word " * 500
    root = tables(
        ingestion_document=[{"id": 1, "content_text": long}, {"id": 1, "content_text": long}, {"id": 2, "content_text": " " * 3000}, {"id": 3, "content_text": None}, {"id": 4, "content_text": "x" * 2000 + "  \n"}, {"id": 5, "content_text": "  " + "x" * 2001}],
        ingestion_chunk=[{"id": 1, "text": "a" * 801}, {"id": 2, "text": ""}, {"id": 3, "text": "b\n" * 100000}],
    )
    assert rows(p2_found(spark, root)) == [("ingestion_chunk", 1), ("ingestion_chunk", 3), ("ingestion_document", 1), ("ingestion_document", 5)]
    made = [r for r in p2_pieces(spark, root).collect() if (r.item_table, r.item_id) == ("ingestion_document", 1)]
    made.sort(key=lambda r: r.piece_no)
    assert "".join(long[r.own_at : r.end_at] for r in made) == long.strip()
    assert all(len(r.text) <= 2000 for r in made) and [r.piece_no for r in made] == list(range(made[0].n_pieces))
    assert rows(p2_found(spark, tables())) == []
