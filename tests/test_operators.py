import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import catalog, enrichment, ingest, query, retrieval
from corpusmill.plans import enrichment as enrichment_plans
from corpusmill.plans import retrieval as plans
from corpusmill.streaming import feedback
from tests.conftest import rows


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=400))
def test_fixed_size_pieces_keep_all_words(value):
    cut = ingest.fixed_size_pieces(value, 50, 10)
    assert all(0 < len(p) <= 52 for p in cut)
    assert not value.strip() or "".join(value.split())[:1] == "".join(cut[0].split())[:1]
    if " " in value and max(map(len, value.split() or [""])) < 10 and "\n\n" not in value:
        assert " ".join(cut).split() == value.split()


def test_fixed_size_pieces_prefer_paragraphs_and_overlap_hard_cuts():
    text = "a" * 30 + "\n\n" + "b" * 60
    assert ingest.fixed_size_pieces(text, 50, 10)[0] == "a" * 30
    assert [len(p) for p in ingest.fixed_size_pieces("x" * 100, 50, 10)] == [50, 50, 20]
    assert ingest.fixed_size_pieces(None) == ingest.fixed_size_pieces(" \n") == []


def test_extract_html(spark):
    page = "<html lang=en><head><title> T </title><meta name=robots content='NOINDEX'><script type='application/ld+json'>{\"@type\": \"NewsArticle\", \"datePublished\": \"2024-01-02\"}</script></head><body><nav><p>menu</p></nav><h1>Head</h1><p>One <b>two<p>three</p><footer><p>foot</p></footer><a href='/x'>l</a></body>"
    got = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(ingest.extract_html("h").alias("x")).select("x.*").collect()
    assert (got[0].title, got[0].body, got[0].links, got[0].section_path, got[0].noindex, got[0].kind, got[0].published) == ("T", "Head\n\nOne two\n\nthree", ["/x"], ["Head"], True, "news", "2024-01-02")
    assert got[1].body is None and got[2].body is None and got[1].links == []


def test_dense_topk_is_exact_in_blocks(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None), (901, [1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in range(7)] + [(99, None)], "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense_topk(queries, vectors, 4, block=3).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(7):
        assert [got[q, k] for k in range(1, 5)] == np.argsort(-(unit @ unit[q]), kind="stable")[:4].tolist()
    assert retrieval.dense_topk(queries.limit(0), vectors, 4).count() == 0


def test_fuse_rewards_both_lists(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    assert [r.id for r in retrieval.fuse([a, b]).orderBy("rank").collect()] == [11, 10, 12]


def test_diversify_takes_the_different_document_and_each_document_once(spark):
    data = [(1, 1, 5, "alpha beta gamma", 0.9), (1, 2, 6, "alpha beta gamma", 0.89), (1, 3, 7, "delta epsilon", 0.8), (1, 4, 5, "zeta", 0.79), (1, 5, 8, None, 0.1)]
    got = retrieval.diversify(spark.createDataFrame(data, "query_id long, id long, document_id long, text string, score double"), 4)
    assert [r.id for r in got.orderBy("rank").collect()] == [1, 3, 2, 5]


def test_keyword_search_wants_all_words(spark):
    queries = spark.createDataFrame([(1, "milk price"), (2, None), (3, "")], "query_id long, query string")
    chunks = spark.createDataFrame([(1, 1, "the price of milk"), (2, 0, "milk, milk price!"), (3, 0, "milk only"), (4, 0, None)], "chunk_id long, sequence_no int, text string")
    assert [tuple(r) for r in retrieval.keyword_search(queries, chunks).orderBy("rank").collect()] == [(1, 2, 0.85, 1), (1, 1, 0.84, 2)]


def test_shared_words_need_no_rarest_word(spark):
    queries = spark.createDataFrame([(1, "milk prices georgia qqtypo"), (2, "qqtypo georgia prices milk"), (3, None), (4, "milk"), (5, "none here")], "query_id long, query string")
    chunks = spark.createDataFrame([(1, "qqtypo alone"), (2, "milk prices"), (3, "georgia milk prices"), (4, None), (5, "milk"), (6, "prices, milk!")], "chunk_id long, text string")
    got = rows(retrieval.shared_words(queries, chunks, 4, block=1))
    assert got == sorted((q, i, n, k) for q in (1, 2) for k, (i, n) in enumerate([(3, 3), (2, 2), (6, 2)], 1))


def test_shared_words_against_brute_force(spark):
    random.seed(5)
    words = [f"word{i}" for i in range(30)]
    queries = [(i, " ".join(random.choices(words, k=random.randrange(1, 9)))) for i in range(300)]
    chunks = [(i, " ".join(random.choices(words, k=random.randrange(0, 12)))) for i in range(900)]
    random.shuffle(chunks)
    expected = []
    for q, asked in queries:
        hits = sorted((-len(set(asked.split()) & set(has.split())), i) for i, has in chunks)
        expected += [(q, i, -n, k) for k, (n, i) in enumerate(hits[:6], 1) if n <= -2]
    got = rows(retrieval.shared_words(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(chunks, "chunk_id long, text string").repartition(5), 4, most=6, block=200))
    assert got == sorted(expected)


def test_keyword_hits_are_those_of_all_pairs_of_words(spark, tables):
    root = tables(
        chat_turn=[{"id": 1, "user_message": "milk prices qqtypo"}],
        ingestion_chunk=[{"id": 1, "document_id": 1, "sequence_no": 0, "text": "qqtypo"}, {"id": 2, "document_id": 2, "sequence_no": 0, "text": "milk prices"}, {"id": 3, "document_id": 3, "sequence_no": 0, "text": "milk prices fell"}],
        ingestion_document=[{"id": i, "canonical_url": f"http://a/{i}"} for i in (1, 2, 3)],
    )
    assert [(r.query_id, r.id, r.n, r["rank"]) for r in plans._keyword_hits(spark, root).orderBy("rank").collect()] == [(1, 2, 2, 1), (1, 3, 2, 2)]
    assert [r.url for r in plans.url_first_wins(spark, root).orderBy("rank").collect()] == ["http://a/2", "http://a/3"]


def test_page_rank_sums_to_one_and_prefers_the_hub(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 0), (0, 4), (4, 4), (9, 0)], "src long, dst long")
    ranks = dict(rows(enrichment.page_rank(edges, nodes, 8)))
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert max(ranks, key=ranks.get) in (0, 4) and ranks[0] > ranks[1]


def test_keyphrases_and_likeness():
    assert enrichment.similar("kitten", "sitting") == pytest.approx(8 / 13)
    assert enrichment.keyphrases(None) == enrichment.keyphrases(" . ") == []
    terms = [t for t, _ in enrichment.keyphrases("Milk production rose. Milk production fell in spring.", 5)]
    assert len(terms) == len(set(terms)) <= 5


def test_keywords_are_of_the_whole_text_and_the_pair(spark, tmp_path):
    data = [(1, 2, "Milk. " + "Wheat harvest. " * 3 + "Exports.", None), (2, 1, "MILK. Births.", "Lead."), (3, 2, " \n", None), (4, None, "Wages 2020. 77", None), (5, 3, "Prices.", None)]
    spark.createDataFrame(data, "id long, locale_pair_doc_id long, content_text string, lead_text string").write.parquet(str(tmp_path / "ingestion_document.parquet"))
    got = {}
    for r in enrichment_plans.keywords(spark, str(tmp_path)).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.keyword)
    own = {i: [t for t, _ in enrichment.keyphrases(text)] for i, _, text, _ in data}
    kept = lambda terms: [t for n, t in enumerate(terms) if len(t) >= 3 and not t.isdigit() and t.lower() not in [o.lower() for o in terms[:n]]]
    assert got == {1: kept(own[1] + own[2]), 2: kept(own[2] + own[1]), 4: kept(own[4]), 5: kept(own[5])}
    assert "Exports" in got[1] and "Births" in got[1] and sum(k.lower() == "milk" for k in got[1]) == 1


def test_curation(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.9), (4, 1.0)], "id long, score double")
    over = spark.createDataFrame([(1, "exclude", None), (2, "demote", None), (3, "boost", None), (4, "boost", "2000-01-01")], "target_id long, action string, e string").withColumn("expires_at", F.to_timestamp("e"))
    got = {r.id: r.curated for r in catalog.curate(base, over, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {2: pytest.approx(0.8), 3: 2.0, 4: 1.0}


def test_entities(spark):
    answer = 'x ```json\n[{"type":"year","value":"in 1995"},{"type":"YEAR","value":"1900"},{"type":"REGION","value":"A","normalizedForm":" r "},{"type":"region","value":"B","normalizedForm":"R"}]\n```'
    got = spark.createDataFrame([(answer,), ("no json",), (None,)], "a string").select(query.entities(F.col("a"), ["YEAR", "REGION"]).alias("e")).collect()
    assert [(e.type, e.form) for e in got[0].e] == [("YEAR", "in 1995"), ("REGION", "r")]
    assert not got[1].e and not got[2].e


def test_spelling_against_brute_force(spark):
    random.seed(3)
    lexicon = ["wage", "wheat", "milk", "price", "exports", "births"]
    words = ["wags", "whet", "mlik", "pricess", "exprots", "births", "zzzzzzz"]
    got = dict(rows(query.spelling(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w, i) for i, w in enumerate(lexicon)], "word string, frequency long"))))
    assert got == {"wags": "wage", "whet": "wheat", "mlik": "milk", "pricess": "price", "exprots": "exports"}


def test_state_accumulates_within_bounds(spark, tmp_path):
    spark.createDataFrame([(i, 1, "purchase") for i in range(150)] + [(999, 2, "error")], "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, user_id long, event_type string").parquet(str(tmp_path / "e"))
    query_ = feedback.accumulate_boosts(stream).writeStream.format("memory").queryName("boosts").outputMode("update").trigger(availableNow=True).start()
    query_.awaitTermination()
    assert rows(spark.table("boosts")) == [(1, 2.0), (2, 0.99)]


def test_dead_letters(spark, tmp_path):
    data = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    seen = {}
    feedback.route_batches(lambda d, n: seen.update(good=rows(d)), lambda d, n: seen.update(bad=d.count()), "x > 0")(data, 0)
    assert seen == {"good": [(1,)], "bad": 2}


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, t int, v string")
    assert rows(feedback.upsert(old, new, ["k"], "t")) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_ranks_over_several_tasks_are_those_of_one(spark):
    random.seed(1)
    data = [(random.choice(["hot", "hot", "hot", None, "b"]), random.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, x int, id int").repartition(7)
    order = [F.desc("x"), F.asc("id")]
    assert sorted(map(str, catalog.ranked_whole(df, ["g"], order).collect())) == sorted(map(str, catalog.ranked(df, ["g"], order).collect()))


def test_nearest_center_and_neighbours_apart(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.1], 5), (2, [0.0, 2.0], 5), (3, [0.9, 0.0], 6), (4, None, 6), (5, [1.0], None)], "id long, vector array<double>, label int")
    centers = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "cluster long, vector array<double>")
    assert [(r.id, r.cluster) for r in retrieval.nearest(vectors, centers).orderBy("id").collect()] == [(1, 7), (2, 8), (3, 7), (4, 7), (5, 7)]
    assert retrieval.nearest(vectors, centers.limit(0)).count() == 0
    with pytest.raises(ValueError):
        retrieval.nearest(vectors, centers, most=1)
    queries = vectors.where("id = 1").select(F.col("id").alias("query_id"), "vector", "label")
    assert [r.id for r in retrieval.dense_topk(queries, vectors, 5, apart="label").orderBy("rank").collect()] == [3, 4, 5]
