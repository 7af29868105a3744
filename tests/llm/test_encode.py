import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import encode
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encode.FOLDER}/{encode.VOCABULARY}"), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return made


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words_are_cut_as_by_the_reference_library(reference, text):
    single = encode._encoder(f"{encode.FOLDER}/{encode.VOCABULARY}").encode_ordinary
    assert [i for w in encode.pre_tokens(text) for i in single(w)] == reference.encode(text, add_special_tokens=False).ids
    assert "".join(encode.pre_tokens(text)) == text


def test_ids_and_round_trip(spark, tables, reference):
    texts = ["", None, " ", "<|endoftext|> x", "don't  stop\r\n\n", "სტატისტიკა 2024", "\x1c\x1fa\x85", "hub " * 20000, "🌾🏛️", "same", "same"]
    root = tables(documents=[{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    got = {r.doc_id: r.ids for r in encode.p8_ids(spark, root).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert dict(rows(encode.p8_decoded(spark, root))) == {i: t or "" for i, t in enumerate(texts)}
    assert rows(encode.p8_ids(spark, tables())) == []
