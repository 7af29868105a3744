import pytest
from pyspark.sql import functions as F

from corpusmill.llm.language import SPELLINGS, fit, label_language, p3_found, p3_pages, p3_spans, romanize
from tests.conftest import rows

EN = "The survey covered rural households in the region that had not been visited before. The price of milk rose again."
DE = "Die Befragung wurde über drei Wochen durchgeführt. Der Anteil ländlicher Haushalte stieg gegenüber dem Vorjahr wieder."
KA = "გამოკვლევამ მოიცვა სოფლის შინამეურნეობები რეგიონში, რომლებიც მანამდე არ მოუნახულებიათ. რძის ფასი ისევ გაიზარდა."
RU = "Опрос проводился в регионе в течение трёх недель. Доля сельских домохозяйств снова выросла."


@pytest.fixture(scope="module")
def model():
    return fit({"en": [EN] * 3 + [DE], "de": [DE] * 3, "ka": [KA]})


def test_main_languages(model):
    for text, lang in ((EN, "en"), (DE, "de"), (KA, "ka"), (RU, "ru"), (romanize(KA), "ka"), (romanize(KA, True), "ka")):
        assert model.main(text)[0] == lang
    assert model.main("1234 ... !!!") == (None, 0.0)
    assert model.main("Ω漢字") == (None, 0.0)


def test_spans_of_one_line(model):
    ka, en, ru, de = model.letters(EN + " " + KA + " " + DE)
    assert ka > 60 and en > 60 and de > 60 and ru == 0


def test_long_runs_have_no_language(model):
    assert model.main("x" * 101)[0] is None
    assert model.main(KA + " " + "abcdef" * 200)[0] == "ka"


def test_labels(spark):
    labels = [(s, lang) for lang, known in SPELLINGS.items() for s in known] + [(" EN-us ", "en"), ("ka_GE", "ka"), ("De", "de"), ("und", None), (None, None), (" ", None), ("unknown", None), ("fr", "other")]
    got = spark.createDataFrame([(a,) for a, _ in labels], "l string").select(label_language(F.col("l"))).collect()
    assert [r[0] for r in got] == [b for _, b in labels]


def test_queries(spark, tables):
    root = tables(
        ingestion_document=[{"id": i, "language": "en", "content_text": EN} for i in range(10, 16)]
        + [{"id": i, "language": "de", "content_text": DE} for i in range(20, 26)]
        + [{"id": i, "language": "ka", "content_text": KA} for i in range(30, 36)]
        + [
            {"id": 1, "language": None, "content_text": KA}, {"id": 1, "language": None, "content_text": KA}, {"id": 2, "language": "en", "content_text": KA + "\n" + EN + "\n" + KA}, {"id": 3, "language": "en", "content_text": None, "title": KA},
            {"id": 4, "language": "en", "content_text": None, "title": None}, {"id": 5, "language": "en", "content_text": "12", "title": EN}, {"id": 6, "language": "en", "content_text": EN + "\nкоротко\n" + RU + "\r\n"}, {"id": None, "content_text": EN},
        ]
    )
    assert rows(p3_found(spark, root)) == [(1, -1, "ka"), (2, -1, "ka"), (2, 1, "en"), (3, -1, "ka"), (6, 2, "ru")]
    pages = {r.document_id: (r.language, r.confidence) for r in p3_pages(spark, root).collect()}
    assert pages[4] == (None, None) and pages[5] == (None, None) and pages[10][0] == "en" and pages[10][1] > 0.9
    spans = {(r.document_id, r.line_no): [] for r in p3_spans(spark, root).collect()}
    for r in p3_spans(spark, root).orderBy("start").collect():
        spans[r.document_id, r.line_no].append((r.start, r.end, r.lang, r.posterior > 0.9))
    assert [x[2:] for x in spans[2, 1]] == [("en", True)] and spans[2, 1][0][:2] == (0, len(EN.rstrip(".")))
    assert {k for k in spans if k[0] == 6} == {(6, 1), (6, 2)} and not any(k[0] == 10 for k in spans)
    assert rows(p3_spans(spark, tables())) == []
    assert rows(p3_found(spark, tables())) == []
