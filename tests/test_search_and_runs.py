import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import display, text
from corpusmill.operators import catalog, enrichment, extraction, hybrid, lifecycle, points, query, retrieval
from corpusmill.operators.lifecycle import CrawlPolicy
from corpusmill.sources import views
from tests.conftest import rows


def values(spark, data, make, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(make).collect()]


def test_rows_once_in_the_scan_and_by_shuffle(spark, tables):
    documents = [{"id": i % 40, "content_text": f"text {i % 40}"} for i in range(100)] + [{"id": None, "content_text": "x"}] * 3
    root = tables(ingestion_document=documents)
    for most in (0, 1000):
        got = views.single_rows(spark, root, "ingestion_document", "id", "content_text", most=most).collect()
        assert sorted((r.id if r.id is not None else -1, r.content_text) for r in got) == sorted([(i, f"text {i}") for i in range(40)] + [(-1, "x")])
        assert {r[0] for r in views.single_rows(spark, root, "ingestion_document", "content_text", most=most).collect()} == {f"text {i}" for i in range(40)} | {"x"}
    assert views.single_rows(spark, tables(), "ingestion_document", "id", "content_text").count() == 0


def test_keyword_hits_against_brute_force(spark):
    random.seed(3)
    words = ["milk", "wheat", "price", "births", "region", "ka", "x1"]
    data = [(i, i % 3, random.choice([None, " ".join(random.choices(words, k=2))]), f"https://a.example/{random.choice(words)}/{i}", random.choice([None, "", " ".join(random.choices(words, k=6))]), random.choice(["ka", "en", None])) for i in range(80)]
    rows_ = spark.createDataFrame(data, "id long, sequence_no int, title string, url string, text string, language string")
    asked = [(1, "Milk price", "en"), (2, "births", None), (3, "  ", "ka"), (4, None, None), (5, "prices in x1", "ka"), (6, "zzz", None)]
    queries = spark.createDataFrame(asked, "query_id long, query string, locale string")
    got = {(r.query_id, r["rank"]): r.id for r in hybrid.keyword_hits(queries, rows_, 5, block=2).collect()}
    import re

    split = lambda s: {w for w in re.split(r"[^\w]+", (s or "").lower()) if w}
    expected = {}
    for q, message, locale in asked:
        if not message or not message.strip():
            continue
        patterns = [message.strip().lower()]
        for w in re.split(r"[^\w]+", message.lower()):
            patterns += [w, w[:-1]] if len(w) >= 5 else [w] if len(w) == 4 else []
        hits = []
        for i, n, title, url, body, language in data:
            tokens = split(body) | split(title) | split(url.replace("/", " "))
            if locale and language != locale:
                continue
            if split(message) <= tokens or any(p in (c or "").lower() for c in (title, url, body) for p in patterns[:8]):
                hits.append((0 if n == 0 else 1, -len(split(message) & tokens), i))
        expected |= {(q, k): h[2] for k, h in enumerate(sorted(hits)[:5], 1)}
    assert got == expected
    assert hybrid.keyword_hits(queries.limit(0), rows_).count() == 0


def test_points_share_their_documents_vector(spark):
    rng = np.random.default_rng(2)
    data = [(d, [float(x) for x in rng.normal(size=4)]) for d in range(12)] + [(12, None)]
    vectors = spark.createDataFrame(data, "document_id long, vector array<double>")
    own = [(10 * d + k, d, ("ka", "en")[d % 2]) for d in range(13) for k in range(1 + d % 3)]
    queries = spark.createDataFrame([(1, data[0][1], "ka"), (2, data[5][1], None)], "query_id long, vector array<double>, locale string")
    got = {(r.query_id, r["rank"]): r.id for r in hybrid.point_hits(queries, vectors, spark.createDataFrame(own, "id long, document_id long, language string"), 6).collect()}
    unit = {d: np.array(v) / np.linalg.norm(v) if v else np.zeros(4) for d, v in data}
    for q, v, locale in ((1, data[0][1], "ka"), (2, data[5][1], None)):
        best = sorted((-round(float(unit[d] @ (np.array(v) / np.linalg.norm(v))), 9), i) for i, d, language in own if locale in (None, language))[:6]
        assert [got[q, k] for k in range(1, 7)] == [i for _, i in best]
    hits = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (1, 7, 0.7, 3)], "query_id long, id long, score double, rank int")
    assert rows(hybrid.after_limit(hits, spark.createDataFrame([(7,), (5,)], "id long")).select("id", "rank")) == [(5, 1), (7, 2)]


def test_ties_and_odd_vectors_in_dense_search(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, None), (98, [1.0]), (97, [0.0, 0.0])], "id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<double>")
    assert [r.id for r in retrieval.dense_topk(queries, vectors, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert {r.id for r in retrieval.dense_topk(queries, vectors, 50).collect()} == {*range(30), 97, 98, 99}


def test_contained_against_brute_force(spark):
    random.seed(1)
    words = ["".join(random.choices("abc", k=random.randint(1, 6))) for _ in range(60)] + [""]
    texts = [(i, "".join(random.choices("abc ", k=random.randint(0, 20)))) for i in range(60)] + [(90, None)]
    got = points.contained(spark.createDataFrame(texts, "query_id long, query string"), spark.createDataFrame([(w,) for w in words], "keyword string"))
    assert set(rows(got)) == {(i, w) for i, t in texts if t for w in words if w and w in t}


@pytest.mark.parametrize("most", [points.KEYWORD_BYTES, 0])
def test_contained_never_broadcasts_the_grams_of_queries(spark, most):
    texts = [(1, "wheat and barley"), (2, "barley"), (2, "rye"), (3, None), (None, "rye bread")]
    words = ["barley", "ye", "r", "", None, "xyz", *(f"word {i}" for i in range(300))]
    asked, known = spark.createDataFrame(texts, "query_id long, query string"), spark.createDataFrame([(w,) for w in words], "keyword string")
    got = points.contained(asked, known, most=most)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == (most > 0)  # queries have fewer bytes than keywords
    assert {tuple(r) for r in got.collect()} == {(q, w) for q, t in texts if t for w in words if w and w in t}


def test_rarest_grams_broadcast_nothing(spark):
    asked = spark.createDataFrame([("abc",), ("abc",), ("bcd",)], "gram string")
    got = points.rarest_grams(asked, spark.createDataFrame([("abcd",), ("xyz",)], "keyword string"), 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("abcd", "bcd")]


def test_latest_patch_wins_as_a_whole(spark):
    base = points.build_points(spark.createDataFrame([(1, 7, "x")], "chunk_id long, document_id long, text string"), spark.createDataFrame([(7, "u", "t", "ka", "news", "live", None)], "document_id long, url string, title string, language string, page_kind string, serve_state string, score_boost double"))
    patches = spark.createDataFrame([(7, 1, "dropped", "zzz", 2.0), (7, 2, "partial", None, 0.5)], "document_id long, patched_at int, serve_state string, page_kind string, score_boost double")
    got = points.patch_payload(base, patches).first().payload
    assert (got.serve_state, got.page_kind, got.score_boost) == ("partial", "news", 0.5)


def test_curation_renames_and_expiry(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    over = spark.sql("select * from values (1, 'rename', timestamp'2024-01-01', null, 'old'), (1, 'rename', timestamp'2024-01-02', null, 'new'), (1, 'rename', timestamp'2024-01-03', timestamp'2024-01-05', 'gone'), (2, 'boost', timestamp'2024-01-01', timestamp'2024-01-01', null) as t(target_id, action, created_at, expires_at, label)")
    got = catalog.curate(spark.createDataFrame([(1, 1.0), (2, 1.0)], "id int, score double"), over, now)
    assert rows(got.select("id", "curated", F.coalesce("renamed", F.lit("-")))) == [(1, 1.0, "new"), (2, 1.0, "-")]
    assert rows(catalog.kept_overrides(over, now).groupBy("target_id").count()) == [(1, 3)]
    assert rows(catalog.reverted(over.where("target_id = 1"), over)) == [(2, "boost")]


def test_display_texts(spark):
    assert values(spark, [("×close",), ("A Cookie notice",), ("fine",), (None,), (" ",)], display.is_display_boilerplate(F.col("v"), ["cookie"]), "v string") == [True, True, False, True, True]
    body = "short\nWe use cookies on this site to remember what you like\n12345 12345 12345 12345 12345 12345 12345 12345\nThe price of milk rose in the whole of the country again.\nMore"
    assert values(spark, [(body,), (None,)], display.lead_paragraph(F.col("v"), ["cookie"]), "v string") == ["The price of milk rose in the whole of the country again.", None]
    assert values(spark, [("Milk", "milk "), ("Milk prices rose", "Milk"), ("Milk " + "x" * 40, "Milk"), ("", "Milk"), (None, "a")], display.duplicates_title(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, False, False]
    assert values(spark, [("ces of milk rose in the whole country",), ("xyz rose",), ("prices of milk rose in the whole country",), ("word",)], display.without_partial_word(F.col("v")), "v string") == ["of milk rose in the whole country", "xyz rose", "prices of milk rose in the whole country", "word"]
    assert values(spark, [("a" * 20,), ("1234 abcd 5",), ("1234",), (None,)], display.looks_like_prose(F.col("v")), "v string") == [True, True, False, False]
    buffers = [('{"x": 1, "intro": "He said \\"hi\\"\\nand',), ('{"intro": "one \\u00e9 two\\u00',), ('{"intro": "back\\\\',), ('{"intro": "',), ('{"int',), (None,), ('{"intro": "whole", "a": "b"}',)]
    assert values(spark, buffers, display.intro_so_far(F.col("v")), "v string") == ['He said "hi"\nand', "one é two", "back\\", "", None, None, "whole"]


def test_sanitize_and_normal_queries(spark):
    data = [("ﬁne  ​text\n Ａ",), (None,), ("",)]
    assert values(spark, data, text.sanitize(F.col("v")), "v string") == ["fine text\n A", None, ""]
    assert values(spark, data, text.sanitize_block(F.col("v")), "v string") == ["fine text A", None, ""]
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"
    assert values(spark, [("What  IS", "en-US"), ("What IS", "ka"), ("A", None)], text.normalized_query(F.col("q"), F.col("l")), "q string, l string") == ["what is", "What IS", "A"]
    assert values(spark, [("5 ტ. ც",), ("7 ათ. ადამ",), ("no sign",), ("1,234",), ("a 7",)], text.is_statistical(F.col("v")), "v string") == [True, True, False, True, False]
    assert values(spark, [("KA-ge",), ("English",), ("  ",), (None,), ("xx",), ("ka_GE.UTF-8",)], text.language_code(F.col("v")), "v string") == ["ka", "en", None, None, "xx", "ka"]


def test_query_pipeline_parts(spark):
    fixes = spark.createDataFrame([("brith", "birth"), ("mlik", "milk")], "word string, fixed string")
    asked = spark.createDataFrame([(1, "Brith, mlik?"), (2, "რძე mlik"), (3, "")], "query_id long, query string")
    assert rows(query.spelled(asked, fixes).select("query_id", "spelled")) == [(1, "birth, milk?"), (2, "რძე milk"), (3, "")]
    hints = query.hinted_entities(F.col("v"), [query.Indicator(("birth",), "births"), query.Indicator(("born",), "Births"), query.Indicator(("wage",), "wage")])
    assert [[tuple(e) for e in found] for found in values(spark, [("born births 2020 and 2020, wage 1900",), ("born",), (None,)], hints, "v string")] == [[("INDICATOR", "births", 0.75), ("INDICATOR", "wage", 0.75), ("YEAR", "2020", 0.85)], [("INDICATOR", "Births", 0.75)], []]
    searched = query.retrieval_text(F.col("q"), F.array(F.lit("b"), F.lit("q")), F.array(F.lit("c"), F.lit("")))
    assert values(spark, [("q",), (" ",), (None,)], searched, "q string") == ["q b c", "", ""]
    assert values(spark, [("NAVIGATION",), ("x",), (None,)], query.chat_intent(F.col("v")), "v string") == ["NAVIGATE", "CONCEPT", "CONCEPT"]
    groups = [query.SmallTalk(("hello",), "k", "e", 10)]
    assert values(spark, [("hello",), ("hello to all of you",), (None,)], query.small_talk(F.col("v"), F.lit(False), groups), "v string") == ["e", None, None]
    lexicon = query.spell_lexicon(spark.createDataFrame([("milk Milk",), ("milk wheat",), (None,)], "text string"), spark.createDataFrame([("WHEAT", 9), ("extra", 1)], "word string, frequency int"))
    assert rows(lexicon) == [("extra", 1), ("milk", 2), ("wheat", 9)]


def test_cluster_signals_against_brute_force(spark):
    random.seed(6)
    words = ["milk", "milkshake", "wheat", "price", "prices", "ab"]
    keywords = [(c, lang, w, r, 0.5 * r) for c in range(4) for lang in ("ka", "en") for r, w in enumerate(random.sample(words, 4), 1)]
    labels = [(c, w) for c, w in enumerate(random.sample(words, 4))]
    asked = [(i, random.choice(["ka", "en"]), " ".join(random.choices(words, k=3))) for i in range(20)] + [(90, "en", "ab")]
    forms = [(i, lang, kind, w) for i, lang, _ in asked for kind, w in ((random.choice(["entity", "expansion"]), random.choice(words)),)]
    got = catalog.match_signals(
        spark.createDataFrame(asked, "query_id long, language string, query string"), spark.createDataFrame(keywords, "cluster long, language string, keyword string, rank int, score double"),
        spark.createDataFrame(labels, "cluster long, label string"), spark.createDataFrame(forms, "query_id long, language string, kind string, form string"), 3,
    )
    expected = {}
    for i, lang, q in asked:
        for c, kl, w, r, s in keywords:
            if len(q) >= 3 and kl == lang and r <= 3 and w in q:
                expected.setdefault((i, c), [0.0] * 4)[0] += s
        for c, w in labels:
            if len(q) >= 3 and w in q:
                expected.setdefault((i, c), [0.0] * 4)[1] = 1.0
    for i, lang, kind, form in set(forms):
        for c, kl, w, r, s in keywords:
            if len(form) >= 3 and kl == lang and r <= 3 and form in w:
                expected.setdefault((i, c), [0.0] * 4)[2 if kind == "entity" else 3] += s
    assert {(r.query_id, r.cluster): [r.keyword, r.label, r.entity, r.expansion] for r in got.collect()} == expected


def test_page_rank_against_brute_force(spark):
    random.seed(7)
    n = 30
    edges = [(random.randrange(n), random.randrange(n + 3)) for _ in range(80)]
    got = {r.id: r["rank"] for r in enrichment.page_rank(spark.createDataFrame(edges, "src long, dst long"), spark.range(n), 20).collect()}
    inside = {(a, b) for a, b in edges if b < n and a != b}
    out = {a: sum(x == a for x, _ in inside) for a in range(n)}
    ranks = dict.fromkeys(range(n), 1 / n)
    for _ in range(20):
        lost = sum(r for a, r in ranks.items() if not out[a])
        ranks = {b: 0.15 / n + 0.85 * (sum(ranks[a] / out[a] for a, x in inside if x == b) + lost / n) for b in range(n)}
    assert all(abs(got[a] - ranks[a]) < 1e-9 for a in range(n)) and abs(sum(got.values()) - 1) < 1e-9
    assert enrichment.page_rank(spark.createDataFrame([], "src long, dst long"), spark.range(0)).count() == 0
    early = {r.id: r["rank"] for r in enrichment.page_rank(spark.createDataFrame(edges, "src long, dst long"), spark.range(n), 100, tolerance=1e-4).collect()}
    assert all(abs(early[a] - ranks[a]) < 1e-2 for a in range(n))


def test_extraction(spark):
    page = """<html lang="en"><head><title>T</title><script type="application/ld+json">{bad</script>
      <script type="application/ld+json">{"@graph": [{"a": 1}, {"@type": "Article", "description": "about", "itemListElement": [{"name": "A"}, {"name": " "}, {"x": 1}]}]}</script></head>
      <body><nav><p>menu</p></nav><article id="a"><h1>Head <b>x</b></h1><p>One<br>two<p>three<ul><li>four<p>five</li><li>six</ul><div class="cookie big"><p>gone</p></div><table><tr><td>1<td>2</table></article><p>after</p>"""
    known = dict(zip([n for n, _ in extraction._FIELDS], extraction.extract(page, "https://a.example/ka/x", extraction.Profile()), strict=True))
    assert known["body"].split("\n\n") == ["Head x", "One two", "three", "four five", "six", "1", "2"]
    assert (known["title"], known["breadcrumb"], known["language"], known["description"], known["type"], known["section_path"]) == ("Head x", "A", "en", "about", "Article", ["Head x"])
    assert extraction.extract(page, None, extraction.LEGACY)[2].endswith("after")
    registry = extraction.registry_of({"default": {"language": "en"}, "rules": [{"corpus": "c", "kind": "", "profile": {"name": "own", "roots": [".x"]}}]})
    assert registry.resolve("c", "news").name == "own" and registry.resolve("d", "news").name == "default" and registry.resolve("c", None).language == "en"
    got = extraction.extracted(spark.createDataFrame([(1, None, None, None, None), (2, "", "u", "", "news"), (3, "<meta name=robots content=noindex><p>x", None, None, None)], "id int, html string, url string, corpus string, kind string")).select("id", "x.*").collect()
    assert got[0].body is None and got[1].strategy == "news" and got[1].body == "" and got[2].noindex and got[2].body is None


def test_runs(spark, tmp_path):
    assert (CrawlPolicy().depth, CrawlPolicy(full_site=True).depth, CrawlPolicy().pages, CrawlPolicy(full_site=True).pages) == (2, 12, 50, None)
    found = spark.createDataFrame([(1, f"u{i}", i % 4, None) for i in range(9)], "corpus_id long, url string, depth int, found_at timestamp")
    assert lifecycle.within_policy(found, CrawlPolicy(max_pages=4)).count() == 4
    assert lifecycle.within_policy(found, CrawlPolicy(full_site=True)).agg(F.max("wait_ms")).first()[0] == 500
    jobs = spark.createDataFrame([(1, False, None), (2, False, None), (3, True, None), (4, False, "https://own.example/"), (5, False, None)], "corpus_id long, full boolean, seed_url string")
    runs = spark.createDataFrame([(1, "running"), (2, "completed")], "corpus_id long, status string")
    seeds = spark.createDataFrame([(c, u) for c in range(1, 6) for u in ("https://a.example/", "https://a.example/?utm_source=x")], "corpus_id long, url string")
    queued = spark.sql("select 2L as corpus_id, concat('https://q.example/', id) as url, 3 as depth, timestamp'2024-01-01' + make_interval(0,0,0,id) as found_at from range(9)")
    got = lifecycle.started(jobs, runs, seeds, queued, most=4).collect()
    assert {(r.corpus_id, r.mode) for r in got} == {(1, "rejected"), (2, "resumed"), (3, "seeded"), (4, "seeded"), (5, "seeded")}
    assert sum(r.corpus_id == 2 for r in got) == 4 and sum(r.corpus_id == 3 for r in got) == 1 and [r.url for r in got if r.corpus_id == 4] == ["https://own.example/"]
    assert lifecycle.run_chain([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 2)]) == [("a", True, ""), ("b", False, "ZeroDivisionError: division by zero"), ("c", True, "")]
    seen = []
    with pytest.raises(RuntimeError):
        lifecycle.to_both(lambda d, n: 1 / 0, lambda d, n: seen.append(n))(spark.range(1), 7)
    assert seen == [7]
    assert lifecycle.refresh_view(spark.range(5), str(tmp_path / "v")) == 5 and lifecycle.refresh_view(spark.range(2), str(tmp_path / "v")) == 2
    lifecycle.log_events(spark.range(2), str(tmp_path / "log"))
    lifecycle.log_events(spark.range(3), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 5


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_engine(spark):
    from corpusmill.api import Engine

    engine = Engine(spark, "/root/testdata/sf0.001")
    hits = engine.search("milk production", "en-GB", 4).collect()
    assert 0 < len(hits) <= 4 and sorted(r["rank"] for r in hits) == list(range(1, len(hits) + 1))
    assert engine.search(" ").count() == 0
    corpora = engine.corpora().collect()
    assert len(corpora) == 240 and any(r.advice == "NO_DATA" for r in corpora)
    one = next(r.corpus_id for r in corpora if r.n_pages)
    found = {r.document_id for r in engine.search("price", corpus=one).collect()}
    assert found <= {r.id for r in views.pages(spark, "/root/testdata/sf0.001", "corpus_id").where(F.col("corpus_id") == one).collect()}
    assert set(engine.catalog()) == {"portals", "links", "keywords"}
