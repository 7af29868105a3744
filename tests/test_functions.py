import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scores, text, urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("url", "normal"),
    [
        ("HTTPS://A.Example/x/?utm_source=1&b=2&Lang=ka#top", "https://a.example/x?b=2"),
        ("http://a.example", "http://a.example/"),
        ("http://a.example/?ref=1", "http://a.example/"),
        ("not a url", "not a url"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_url(spark, url, normal):
    assert one(spark, url, urls.normalize_url) == normal


def test_url_parts(spark):
    assert one(spark, "https://x.example/ka/page", urls.url_locale) == "ka"
    assert one(spark, "https://x.example/kate/page", urls.url_locale) is None
    assert one(spark, "https://x.example/KA/page", lambda u: urls.rewrite_locale(u, "en")) == "https://x.example/KA/page"
    assert one(spark, "https://x.example/ka/a.PDF?x=1", urls.is_binary_url)
    assert one(spark, " My  Corpus!! ", urls.collection_name) == "my-corpus"
    assert one(spark, None, urls.collection_name) == "default"


def test_texts(spark):
    assert one(spark, " A  b\n", text.content_hash) == one(spark, "a B", text.content_hash)
    assert one(spark, "  ", text.content_hash) is None
    assert one(spark, "abcde", text.token_estimate) == 2
    assert one(spark, None, text.token_estimate) == 0
    assert one(spark, "სტატისტიკა ab", text.script_language) == "ka"
    assert one(spark, "hello", text.script_language) == "en"
    assert one(spark, None, text.script_language) == "ka"
    assert one(spark, "grew 8.7 % in 2024", text.is_statistical)
    assert not one(spark, "no figures here", text.is_statistical)
    assert one(spark, "one two three four", lambda t: text.excerpt(t, 10)) == "one two..."
    assert one(spark, "trade", lambda t: text.search_patterns(t)) == ["trade", "trad"]
    assert one(spark, "ﬁne", text.nfkc) == "fine"
    assert one(spark, None, text.nfkc) is None
    assert one(spark, "a​b­c-d", text.sanitize) == "abc-d"


def test_scores(spark):
    assert one(spark, [3.0, 4.0], scores.normalized, "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], scores.normalized, "array<double>") == [0.0, 0.0]
    assert one(spark, [1.0], lambda v: scores.cosine(v, F.array(F.lit(1.0), F.lit(0.0))), "array<double>") == 0.0
    assert one(spark, 0.8, lambda v: scores.confidence(v, F.lit(0.7)), "double") == "HIGH"
    assert one(spark, 0.8, lambda v: scores.confidence(v, F.lit(0.79)), "double") == "MEDIUM"
    assert one(spark, None, lambda v: scores.confidence(v, v), "double") == "NONE"
